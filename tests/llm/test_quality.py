import random
import zlib

import numpy as np
import pytest

from tidyledger.llm import quality


def text_of(r, good):
    words = ["".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(r.randint(5, 60))]
    if good:
        return " ".join(words).capitalize() + "."
    return r.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + "%%%" for w in words)])


@pytest.fixture(scope="module")
def trained():
    r = random.Random(1)
    rows = [(text_of(r, i % 3 > 0), int(i % 3 > 0)) for i in range(400)]
    return quality.train([t.encode() for t, _ in rows], np.array([y for _, y in rows], np.float32), epochs=4)


def test_gradients_are_those_of_the_loss():
    net = quality.Network.fresh(1).parts
    net = {k: v.astype(np.float64) for k, v in net.items()}
    texts = [b"ab" * 40, b"A tale of two!", b"x" * 900]
    parts = [quality.chunks_of(t) for t in texts]
    chunks, starts = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])
    y, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        pools = quality.pooled(net, chunks)[0]
        z = quality.document_vectors(net, pools, starts)[2] @ net["w2"] + net["b2"]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / len(y))

    grads = quality._gradients(net, chunks, starts, y, weight)
    for name, g in quality._gradients(net, chunks, starts, y, weight, block=2).items():
        assert g == pytest.approx(grads[name], abs=1e-6)
    for name, at in (("table", (2, ord("b"), 3)), ("bias", (4,)), ("w1", (5, 2)), ("w2", (15,)), ("b2", (0,))):
        before, step = net[name][at], 1e-5
        net[name][at] = before + step
        up = loss()
        net[name][at] = before - step
        down = loss()
        net[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)


def test_held_out_texts_are_told_apart(trained):
    r = random.Random(2)
    rows = [(text_of(r, i % 2), i % 2) for i in range(200)]
    p = quality.probabilities(trained.parts, [t.encode() for t, _ in rows])
    assert ((p >= quality.THRESHOLD) == np.array([y for _, y in rows], bool)).mean() > 0.95


def test_chunks_cover_every_byte_and_blocks_change_nothing(trained):
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        chunks = quality.chunks_of(bytes(i % 251 for i in range(n)))
        seen = {(c * (quality.CHUNK - quality.OVERLAP) + j) for c in range(len(chunks)) for j in range(quality.CHUNK)
                if chunks[c, j] != quality.PAD}
        assert seen == set(range(n))
    texts = [("word " * n).encode() for n in (0, 3, 700, 4000)]
    whole = quality.probabilities(trained.parts, texts, block=10_000)
    assert quality.probabilities(trained.parts, texts, block=3) == pytest.approx(whole, abs=1e-6)


def test_every_row_is_scored_and_labels_stay_out(spark, docs_of, odd_rows):
    r = random.Random(3)
    rows = odd_rows + [(100 + i, text_of(r, i % 2)) for i in range(120)]
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(120)] + [(5, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs_of(rows), labels).collect()
    assert sorted((g.doc_id for g in got), key=repr) == sorted((d for d, _ in rows), key=repr)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    assert all(g.held_out == (zlib.crc32(("" if g.doc_id is None else str(g.doc_id)).encode()) % 5 == 0) for g in got)
    # Labels of held-out rows are not learned: turning them over changes no score.
    turned = spark.createDataFrame(
        [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 0) for d, q in ((100 + i, i % 2) for i in range(120))],
        labels.schema)
    again = {(g.doc_id, g.score) for g in quality.quality_scores(docs_of(rows), turned).collect()}
    assert again == {(g.doc_id, g.score) for g in got}
    kept = quality.keep_good(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns
    assert kept.count() == sum(g.predicted for g in got)


def test_no_labels_and_no_documents(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [g.score for g in quality.quality_scores(docs_of([(1, "a")]), labels).collect()] == [0.5]
    assert quality.quality_scores(docs_of([]), labels).count() == 0
