"""License scan with a positional index of rare words.

Templates are short licence texts. Their words carry an inverse document
frequency over the scanned corpus, and each template is represented by its
rarest words with their positions. A file looks its own rare words up, each hit
votes for a template and the position at which it would start, and votes within
a small drift of each other support one alignment. An alignment with enough support
counts only if the template's mandatory key phrases stand in the file behind it.
Exact places of the base phrases are counted in any case.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import id_back, id_text, ship

# Words that must stand consecutively, and the label they give.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, licence wording, and key phrases without which an alignment does not count.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
               "the license you may obtain a copy of the license at",
     ("licensed under the apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation either version 3 of the license or at your option any later "
            "version", ("gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software",)),
    ("cc-by", "licensed under cc by 4 0", ("licensed under cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("licensed under cc by sa 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed under cc by nc 4 0",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("licensed under cc by nc sa 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("public-domain", "this is free and unencumbered software released into the public domain",
     ("released into the public domain",)),
)

RARE_WORDS = 8  # rarest words that stand for a template
DRIFT = 3  # words by which hits of one alignment may be apart
SUPPORT = 0.6  # share of a template's rare words that must support an alignment

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and any other non-ASCII characters, with A-Z lower-cased."""
    return ("" if text is None else text).encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def vocabulary() -> dict[bytes, None]:
    """The licence words, bounded by the templates."""
    return dict.fromkeys(w for _, text, keys in TEMPLATES for w in words_of(" ".join((text, *keys)))) | dict.fromkeys(
        w for phrase, _ in BASE for w in phrase.encode().split())


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of documents with each licence word, over the whole corpus."""
    ship(docs.sparkSession)
    known = frozenset(vocabulary())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, Counter()
        for batch in batches:
            for text in batch["text"]:
                n += 1
                seen.update(known.intersection(words_of(text)))
        yield pd.DataFrame([("", n)] + [(w.decode(), c) for w, c in seen.items()], columns=["word", "n"])

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class RareWordIndex:
    """Postings of each template's rarest words: word -> (template, position); and what verifies a hit."""

    def __init__(self, n_docs: int, frequencies: dict[bytes, int]):
        def idf(word: bytes) -> float:
            return math.log((n_docs + 1) / (frequencies.get(word, 0) + 1))

        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weight: list[float] = []
        self.needed: list[float] = []
        self.idf = {}
        for t, (_, text, _) in enumerate(TEMPLATES):
            words = text.encode().split()
            rare = sorted(dict.fromkeys(words), key=lambda w: (-idf(w), w))[:RARE_WORDS]
            for position, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((t, position))
                    self.idf[word] = idf(word) + 1e-6
            self.weight.append(sum(self.idf[w] for w in rare))
            self.needed.append(SUPPORT * self.weight[-1])
        self.keys = [[k.encode().split() for k in keys] for _, _, keys in TEMPLATES]
        self.lengths = [len(text.split()) for _, text, _ in TEMPLATES]
        self.base = [(phrase.encode().split(), label) for phrase, label in BASE]
        self.anchors = frozenset(w for words, _ in self.base for w in words[-1:])
        self.interesting = frozenset(self.postings) | self.anchors

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
        words = words_of(text)
        starts, base = [], set()
        hits: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
        interesting, anchors, postings = self.interesting, self.anchors, self.postings
        for at in [i for i, w in enumerate(words) if w in interesting]:
            word = words[at]
            if word in anchors:
                for phrase, label in self.base:
                    start = at - len(phrase) + 1
                    if start >= 0 and words[start:at + 1] == phrase:
                        starts.append(start)
                        base.add(label)
            for template, position in postings.get(word, ()):
                hits[template].append((at - position, at, word))
        labels, best = set(base), 1.0 if base else 0.0
        for template, found in hits.items():
            score = self._aligned(template, found, words)
            if score:
                labels.add(TEMPLATES[template][0])
                best = max(best, score)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, best))

    def _aligned(self, template: int, found: list[tuple[int, int, bytes]], words: list[bytes]) -> float:
        """Best support of an alignment whose key phrases are all there, as a share; 0 without one."""
        if sum({w: self.idf[w] for _, _, w in found}.values()) < self.needed[template]:
            return 0.0
        found.sort()
        best, left = 0.0, 0
        inside: Counter = Counter()
        support = 0.0
        for right, (origin, _, word) in enumerate(found):
            if not inside[word]:
                support += self.idf[word]
            inside[word] += 1
            while found[left][0] < origin - DRIFT:
                gone = found[left][2]
                inside[gone] -= 1
                if not inside[gone]:
                    support -= self.idf[gone]
                left += 1
            if support >= self.needed[template] - 1e-9 and support > best * self.weight[template] + 1e-9:
                if self._has_keys(template, words, max(0, found[left][0] - DRIFT), origin):
                    best = support / self.weight[template]
        return best

    def _has_keys(self, template: int, words: list[bytes], low: int, high: int) -> bool:
        part = words[low:high + self.lengths[template] + DRIFT + 1]
        joined = b" " + b" ".join(part) + b" "
        return all(b" " + b" ".join(key) + b" " in joined for key in self.keys[template])


RESULT = ("doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty: no words, no labels, score 0. Overlapping places of base phrases all count. Repeated rows
    and null ids are scanned like any other; no documents give no rows. Other columns are never read. Only the index
    of the templates goes to the tasks; texts are not shuffled.
    """
    index = RareWordIndex(*document_frequencies(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *index.scan(t)) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return id_back(docs.select(id_text("doc_id"), "text").mapInPandas(run, RESULT), "doc_id")
