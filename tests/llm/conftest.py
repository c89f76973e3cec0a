import pytest

CLASHING = ("row", "doc", "key", "node", "score", "bucket", "copies", "place", "tokens", "n", "runs", "text_sha256",
            "keep_id", "piece", "host", "part", "skeleton", "quality")


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with extra columns named as the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *(["x"] * len(CLASHING)))
                for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, "
            + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)

    return make


@pytest.fixture
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \t\n "), (None, "a lone text without an id"), (None, None), (4, long), (5, long),
            (6, "short"), (6, "short"), (6, "another text of the same id"), (7, "Short"), (8, "é ü\u0085x \x1c y"), (9, "a" * 5000)]
