import math
import random
from collections import Counter, defaultdict

import pytest

from tidyledger.llm import mixing


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def test_weights_meet_the_entropy_or_the_repetition_limit():
    tokens = {"a": 900, "b": 90, "c": 10}
    given = mixing.allotments(tokens, target_entropy=0.6, max_repeats=1000)
    assert entropy(w for w, _ in given.values()) == pytest.approx(0.6 * math.log(3), abs=1e-6)
    given = mixing.allotments(tokens, target_entropy=0.9, max_repeats=5)
    assert max(n / tokens[s] for s, (_, n) in given.items()) == pytest.approx(5, abs=0.1)
    assert mixing.allotments({"a": 5, "b": 5})["a"] == (0.5, 5)
    assert mixing.allotments({"a": 0, "b": 7}) == {"a": (0.0, 0), "b": (1.0, 7)}
    assert mixing.allotments({}) == {}
    # A budget that even the plain shares repeat too often leaves the shares as they are.
    assert mixing.temperature(tokens, 100_000, 0.9, 4) == 1.0


def test_copies_add_up_to_the_allotments(docs_of, odd_rows):
    r = random.Random(1)
    rows = [(*x, None) for x in odd_rows if not x[1] or len(x[1]) < 6000] + [
        (100 + i, " ".join(["w"] * r.randint(1, 30)), r.choices(["big", "mid", "tiny"], [80, 15, 5])[0]) for i in range(800)]
    docs = docs_of(rows)
    got = mixing.mix(docs, target_entropy=0.9, max_repeats=3, blocks=8).select(
        "row.doc_id", "row.text", "source", "tokens", "copies").collect()
    assert Counter((g.doc_id, g.text) for g in got) == Counter((d, t) for d, t, _ in rows)
    tokens, longest, used = Counter(), Counter(), Counter()
    seen = defaultdict(set)
    for g in got:
        assert g.tokens == len((g.text or "").encode().split())
        tokens[g.source] += g.tokens
        longest[g.source] = max(longest[g.source], g.tokens)
        used[g.source] += g.tokens * g.copies
        seen[g.source].add(g.copies)
        assert g.tokens or g.copies
    for source, (_, allotted) in mixing.allotments(dict(tokens), target_entropy=0.9, max_repeats=3).items():
        assert allotted - longest[source] * 2 <= used[source] <= allotted
        assert max(seen[source]) - min(seen[source]) <= 1
    mixed = mixing.mixture(docs, target_entropy=0.9, max_repeats=3, blocks=8)
    assert mixed.columns == docs.columns and mixed.count() == sum(g.copies for g in got)


def test_no_documents(docs_of):
    assert mixing.mixture_report(docs_of([])).count() == 0
    assert mixing.mixture(docs_of([])).count() == 0
