import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd

from tidyledger.llm import exact_dedup
from tidyledger.llm.exact_dedup import CuckooFilter, DigestIndex, built

LOWER = {c: c + 32 for c in range(65, 91)}


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def test_groups_equal_brute_force(docs_of, odd_rows):
    rows = odd_rows + [(20, "Ähnlich"), (21, "ähnlich"), (22, "ÄHNLICH"), (23, "ÄhnlicH")]
    got = exact_dedup.exact_groups(docs_of(rows)).collect()
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[digest(text)].append(doc_id)
    want = []
    for doc_id, text in rows:
        ids = groups[digest(text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((doc_id, keep, len(ids), doc_id == keep, digest(text)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_dropping_keeps_columns_and_one_row_of_each_group(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(digest(r.text) for r in kept.collect()) == sorted({digest(t) for _, t in odd_rows})


def test_no_documents(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).count() == 0
    assert exact_dedup.drop_exact(docs_of([])).count() == 0


def test_filter_has_no_false_negatives_and_forgets_what_is_deleted():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)
    index = CuckooFilter.for_keys(len(keys))
    assert index.insert(keys) and index.contains(keys).all()
    index.delete(keys[:2500])
    assert index.contains(keys[2500:]).all()
    assert index.contains(keys[:2500]).mean() < 0.02


def test_overflow_is_resized_from_stored_keys():
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    assert not CuckooFilter(16).insert(exact_dedup.filter_keys(digests))
    assert built(digests).contains(exact_dedup.filter_keys(digests)).all()


def test_index_takes_batches_and_deletions(spark):
    a, b, c = (digest(x) for x in "abc")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text_sha256 string")
    index = DigestIndex.empty(spark, 1).insert(rows((1, a), (2, a), (3, b))).insert(rows((5, a), (1, b), (4, c)))
    assert sorted(map(tuple, index.live().collect())) == sorted([(a, 5, 3, 1), (b, 3, 2, 1), (c, 4, 1, 1)])
    index = index.delete(rows((0, a), (0, digest("never seen"))))
    assert {r.text_sha256 for r in index.live().collect()} == {b, c}
    assert sorted(map(tuple, index.insert(rows((9, a))).live().collect()))[0:3] == sorted([(a, 9, 1, 1), (b, 3, 2, 1), (c, 4, 1, 1)])


def test_number_of_batches_changes_nothing_and_ids_stay_exact(docs_of, odd_rows):
    rows = odd_rows + [(2**60 + i, f"text {i % 5}") for i in range(1, 40)] + [(None, f"text {i}") for i in range(8)]
    docs = docs_of(rows)
    one, many = (sorted(map(tuple, exact_dedup.exact_groups(docs, n).collect()), key=repr) for n in (1, 5))
    assert one == many
    largest = {i % 5: 2**60 + i for i in range(1, 40)}
    assert {r[1] for r in many if r[4] in {digest(f"text {i}") for i in range(5)}} == set(largest.values())


def test_only_hits_of_the_filter_reach_the_stored_keys(monkeypatch):
    def batch(*rows):
        return pd.DataFrame([(3, digest(t), i, False, 1, 1) for t, i in rows],
                            columns=["bucket", *exact_dedup.KEY]).astype({"keep_id": "int64"})

    none = pd.DataFrame({c: [] for c in ("bucket", *exact_dedup.KEY, "room", "slots")})
    state = exact_dedup._merge_bucket(none, batch(("a", 1), ("b", 2)), False)
    after = exact_dedup._merge_bucket(state, batch(("a", 9), ("c", 4)), False)
    assert list(after["keep_id"][:-1]) == [9, 2, 4] and list(after["group_size"][:-1]) == [2, 1, 1]
    monkeypatch.setattr(CuckooFilter, "contains", lambda self, keys: np.zeros(len(keys), bool))
    missed = exact_dedup._merge_bucket(state, batch(("a", 9)), False)
    assert list(missed["text_sha256"][:-1]) == [digest("a"), digest("b"), digest("a")]
