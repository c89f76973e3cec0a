from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference, duck
from tidyledger.llm import catalog

SMALLEST = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SMALLEST).exists(), reason="needs the driver's tables")


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == set(range(1, 14))
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, name):
    assert difference(catalog.QUERIES[name](spark, SMALLEST), duck(SMALLEST), catalog.ORACLES[name]) is None


@needs_tables
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    columns, before = docs.columns, Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALLEST), f"test-{name}")
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        assert docs.columns == columns and set(after) <= set(before)
        if name == "exact_dedup":
            lowered = Counter("".join(c.lower() if c < "\x80" else c for c in t or "") for _, t in after.elements())
            assert max(lowered.values()) == 1
        if name != "mix_sources":
            assert max(after.values()) == 1
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALLEST)
    assert {(r.doc_id) for r in last.collect()} == {d for d, _ in before}
    assert last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
