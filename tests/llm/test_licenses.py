import re

from tidyledger.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT = licenses.TEMPLATES[0][1]
ROWS = [
    (100, "Released under the MIT License."), (101, "MIT  license, MIT-license; the Apache License and General\nPublic-License"),
    (102, "MITlicense ümit license mit licensé"), (103, MIT), (104, "head " * 50 + MIT.upper().replace(" ", ", ") + " tail" * 9),
    (105, " ".join(w for i, w in enumerate(MIT.split()) if i != 30)), (106, "Licensed under CC BY-NC 4.0."),
    (107, "Licensed under CC BY 4.0."), (108, "granted charge person copy software sublicense merge rights"),
    (109, "All rights reserved."), (110, "mit license " * 300)]


def test_words_and_base_places_equal_brute_force(docs_of, odd_rows):
    rows = odd_rows + ROWS
    got = licenses.scan(docs_of(rows)).collect()
    want = [(d, *base(t)) for d, t in rows]
    assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=repr) == sorted(
        want, key=repr)
    labels = {g.doc_id: g.labels for g in got}
    assert [labels[i] for i in range(103, 111)] == ["mit", "mit", "mit", "cc-by-nc", "cc-by", "", "proprietary", "mit"]
    assert all(set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1 for g in got)
    assert all((g.score > 0) == bool(g.labels) for g in got)


def test_no_documents(docs_of):
    assert licenses.scan(docs_of([])).count() == 0
