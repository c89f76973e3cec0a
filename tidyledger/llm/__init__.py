"""Operators for preparing training data: documents, embeddings and pages at corpus scale."""
