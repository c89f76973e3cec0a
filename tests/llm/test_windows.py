"""Byte and word windows that repeat, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidyledger.llm import sampling, substring, suffixes

LAST = 1 << 63


def brute(rows, length, tokens, strictly_smaller_document):
    """Flags of removed units per row, by reading every window in document order."""
    first, windows = {}, []
    for doc_id, text in rows:
        units = tokens(text or "")
        doc = LAST if doc_id is None else doc_id
        for p in range(len(units) - length + 1):
            w = tuple(units[p:p + length])
            windows.append((w, doc, p))
            place = (doc,) if strictly_smaller_document else (doc, p)
            first[w] = min(first.get(w, place), place)
    out = []
    for doc_id, text in rows:
        units = tokens(text or "")
        doc = LAST if doc_id is None else doc_id
        gone = np.zeros(len(units), bool)
        for p in range(len(units) - length + 1):
            place = (doc,) if strictly_smaller_document else (doc, p)
            if first[tuple(units[p:p + length])] < place:
                gone[p:p + length] = True
        out.append((units, gone))
    return out


def corpus(odd_rows):
    r = random.Random(5)
    words = ["the", "of", "und", "é"] + [f"s{i}" for i in range(60)]
    base = [r.choices(words, k=160) for _ in range(4)] + [["same"] * 130]
    rows = [x for x in odd_rows if not x[1] or len(x[1]) < 6000]
    for i in range(40):
        text = list(r.choice(base) * r.choice([1, 1, 2]))
        for _ in range(r.choice([0, 0, 1, 3])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((50 + i, r.choice([" ", "\n"]).join(text[r.choice([0, 0, 13]):])))
    rows.append((200, rows[-1][1]))
    rows.append((200, rows[-1][1]))
    return rows


@pytest.mark.parametrize("tree_rows", [50_000, 5])
def test_word_windows(docs_of, odd_rows, tree_rows):
    rows = corpus(odd_rows)
    got = substring.deduplicate(docs_of(rows), tree_rows=tree_rows).collect()
    want = []
    for (doc_id, _), (units, gone) in zip(rows, brute(rows, 50, lambda t: t.encode().split(), True)):
        kept = b" ".join(w for w, g in zip(units, gone) if not g)
        want.append((doc_id, len(units), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_byte_windows(docs_of, odd_rows):
    rows = corpus(odd_rows)
    got = suffixes.deduplicate(docs_of(rows)).collect()
    want = []
    for (doc_id, _), (units, gone) in zip(rows, brute(rows, 100, lambda t: t.encode(), False)):
        kept = bytes(b for b, g in zip(units, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((doc_id, len(units), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_documents(docs_of):
    assert substring.deduplicate(docs_of([])).count() == 0
    assert suffixes.deduplicate(docs_of([])).count() == 0


def test_long_texts_are_gone_through_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(sampling, "UNITS_PER_CALL", 700)
    r = random.Random(6)
    text = "".join(r.choices("abcdefgh", k=3000))
    parts = [p for s in (0, 1500) for p in [text[s:s + 1500]]]
    rows = [(1, text), (2, "x" + parts[1] + "y" + parts[0])]
    units = [sampling.BYTES.named(sampling.BYTES.split(t)) for _, t in rows]
    found = [sampling.segments(u, np.array([0]), 100, 32) for u in units]
    assert sum(f[2].sum() for f in found) == sum(len(u) - 99 for u in units)
    got = {r.doc_id: r.n_removed for r in suffixes.deduplicate(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 3000}


def test_names_tell_grams_apart_and_join():
    units = sampling.BYTES.named(sampling.BYTES.split("abcabcabd" * 20))
    for length in (1, 3, 5, 8, 13):
        names = sampling.Names(units).of(length)
        text = "abcabcabd" * 20
        by_text = {}
        for i, name in enumerate(names.tolist()):
            by_text.setdefault(text[i:i + length], set()).add(name)
        assert all(len(v) == 1 for v in by_text.values())
        assert len(set().union(*by_text.values())) == len(by_text)


def test_subtree_nodes():
    paths = np.array([[1, 1], [1, 2], [1, 1], [2, 1], [1, 1]])
    tree = substring.Subtree(paths)
    assert [list(map(int, x)) for x in tree.nodes(2)] == [[0], [2]]
    assert [list(map(int, x)) for x in tree.nodes(1)] == [[0], [3]]
    assert sorted(tree.later(np.array([5, 0, 4, 0, 4]), 2).tolist()) == [0]
