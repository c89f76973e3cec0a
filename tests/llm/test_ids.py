"""Ids above 2^53 next to a null id in one batch come out as they went in."""

import pytest
from public_tokenizers import path as vocabulary

from tidyledger.llm import exact_dedup, html_extract, licenses, packing, simhash, substring, suffixes

IDS = [2**60 + 1, 2**60 + 3, None, 2**53 + 1, -(2**61) - 1, 7]


@pytest.mark.parametrize("name,run", [
    ("op1", lambda d: substring.deduplicate(d, with_text=False)), ("op3", lambda d: simhash.near_groups(d, shingle=4, distance=4)),
    ("op4", licenses.scan), ("op5", exact_dedup.exact_groups), ("op6", lambda d: suffixes.deduplicate(d, with_text=False)),
    ("op10", lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")))])
def test_documents(docs_of, name, run):
    docs = docs_of([(i, f"text number {n} under the mit license " + "word " * 60) for n, i in enumerate(IDS)]).coalesce(1)
    out = run(docs)
    assert dict(out.dtypes)["doc_id"] == "bigint" and "kept_sha256" in out.columns or name not in ("op1", "op6")
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(IDS, key=repr)


def test_pages(spark):
    rows = [(i, f"http://a/{n}", f"<html><body><article><p>Page {n} has a text.</p></article></body></html>") for n, i in enumerate(IDS)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert {(r.page_id, r.text) for r in out.collect()} == {(i, f"Page {n} has a text.") for n, i in enumerate(IDS)}
