"""Similarity of short names: twice the longest common subsequence over both lengths.

Spark has no LCS, so this is the one place where names go through Arrow into
numpy. The LCS is computed bit-parallel: one machine word per 64 characters of
the seed, all values of a batch at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Ship these helpers with the query, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ratio(lcs, len_a, len_b):
    """Whole-number similarity 0..100, rounded half to even; two empty names are equal."""
    total = np.maximum(np.asarray(len_a) + np.asarray(len_b), 1)
    distance = np.asarray(len_a) + np.asarray(len_b) - 2 * np.asarray(lcs)
    return np.rint((1.0 - distance / total) * 100.0).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Names:
    """Many names as one matrix of letter numbers: a column per name, a row per position."""

    def __init__(self, names):
        codes = [code_points(n) for n in names]
        self.lengths = np.array([len(c) for c in codes], dtype=np.int64)
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        self.letters, inverse = np.unique(flat, return_inverse=True)
        width = int(self.lengths.max()) if len(codes) else 0
        present = np.arange(width)[:, None] < self.lengths[None, :]
        by_name = np.full((len(codes), width), len(self.letters), dtype=np.int32)
        by_name[present.T] = inverse
        self.matrix = np.ascontiguousarray(by_name.T)

    def lcs(self, seed: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """LCS of ``seed`` with the names ``start:stop``."""
        stop = len(self.lengths) if stop is None else stop
        seed_codes = code_points(seed)
        n_words = max(1, -(-len(seed_codes) // 64))
        # place[w][letter]: where the letter stands in word w of the seed.
        place = np.zeros((n_words, len(self.letters) + 1), dtype=np.uint64)
        at = np.searchsorted(self.letters, seed_codes)
        for i, (pos, code) in enumerate(zip(at, seed_codes)):
            if pos < len(self.letters) and self.letters[pos] == code:
                place[i // 64, pos] |= np.uint64(1 << (i % 64))
        open_bits = [np.full(stop - start, ~np.uint64(0)) for _ in range(n_words)]
        width = int(self.lengths[start:stop].max()) if stop > start else 0
        for letters in self.matrix[:width, start:stop]:
            carry = None
            for w in range(n_words):
                v = open_bits[w]
                hit = v & place[w][letters]
                total = v + hit
                over = total < v
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < n_words else None
                open_bits[w] = total | (v - hit)
        closed = np.zeros(stop - start, dtype=np.int64)
        for w in range(n_words):
            bits = min(64, len(seed_codes) - 64 * w)
            mask = np.uint64((1 << bits) - 1) if bits > 0 else np.uint64(0)
            closed += np.bitwise_count(~open_bits[w] & mask)
        return closed


class Texts:
    """Texts as one flat array of code points."""

    def __init__(self, texts):
        codes = [code_points(t) for t in texts]
        self.lengths = np.array([len(c) for c in codes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)

    def places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text among the chosen, position in it, index into ``flat``) of all their letters."""
        lengths = self.lengths[chosen]
        row = np.repeat(np.arange(len(chosen)), lengths)
        position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return row, position, self.starts[chosen][row] + position


def lcs_pairs(left: Texts, right: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS of ``left[i[k]]`` and ``right[j[k]]`` for all k at once, in chunks of bounded size."""
    out = np.zeros(len(i), dtype=np.int64)
    letters, numbers = np.unique(left.flat, return_inverse=True)
    if not len(letters):
        return out
    at = np.minimum(np.searchsorted(letters, right.flat), len(letters) - 1)
    others = np.where(letters[at] == right.flat, at, len(letters)).astype(np.int32)
    words, width = np.maximum(1, -(-left.lengths[i] // 64)), right.lengths[j]
    order, done = np.lexsort((i, width, words)), 0
    while done < len(order):
        n_words = int(words[order[done]])
        size = min(1 << 16, max(1, (1 << 23) // (n_words * (len(letters) + 1))))
        size = min(size, int(np.searchsorted(words[order], n_words, side="right")) - done)
        while size > 1 and int(width[order[done + size - 1]]) * size > 1 << 23:
            size //= 2
        chunk = order[done:done + size]
        done += size
        used, seed = np.unique(i[chunk], return_inverse=True)
        # place[text, word, letter]: where the letter stands in that word of the left text.
        place = np.zeros((len(used), n_words, len(letters) + 1), dtype=np.uint64)
        row, position, flat = left.places(used)
        np.add.at(place, (row, position // 64, numbers[flat]), np.uint64(1) << (position % 64).astype(np.uint64))
        matrix = np.full((int(width[chunk].max()), size), len(letters), dtype=np.int32)
        row, position, flat = right.places(j[chunk])
        matrix[position, row] = others[flat]
        open_bits = [np.full(size, ~np.uint64(0)) for _ in range(n_words)]
        for step in matrix:
            carry = None
            for w in range(n_words):
                v = open_bits[w]
                hit = v & place[seed, w, step]
                total = v + hit
                over = total < v
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < n_words else None
                open_bits[w] = total | (v - hit)
        for w in range(n_words):
            bits = np.clip(left.lengths[i[chunk]] - 64 * w, 0, 64).astype(np.uint64)
            mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
            out[chunk] += np.bitwise_count(~open_bits[w] & mask)
    return out


def pair_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of ``a[i]`` and ``b[i]``; equal left names share their letter table."""
    different, left = np.unique(np.array(a, dtype=object), return_inverse=True)
    seeds, others = Texts(different.tolist()), Texts(b)
    return ratio(lcs_pairs(seeds, others, left, np.arange(len(b))), seeds.lengths[left], others.lengths)


@F.pandas_udf(T.LongType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.array([None] * len(a), dtype="Int64"))
    if known.any():
        out[known] = pair_ratio(a[known].tolist(), b[known].tolist())
    return out


def indel_ratio(a, b):
    """0..100 similarity of two name columns, ignoring case."""
    return _indel_ratio(F.lower(a), F.lower(b))


class Leaders:
    """The cluster leaders among a bounded, ranked block of names.

    Going down the ranks, a name becomes a leader unless an earlier leader is
    at least ``threshold`` similar to it.
    """

    def __init__(self, block: list[tuple[str, str]], threshold: int):
        self.threshold = threshold
        # Names further apart in length than this cannot reach the threshold.
        low = max(threshold - 0.5, 0.0) / 100.0
        self.reach = low / (2.0 - low)
        self.found: list[tuple[str, str]] = []
        lowered = Names([low_name for _, low_name in block])
        taken = np.zeros(len(block), dtype=bool)
        for i, (name, low_name) in enumerate(block):
            if taken[i]:
                continue
            self.found.append((name, low_name))
            near = ratio(lowered.lcs(low_name, i), lowered.lengths[i], lowered.lengths[i:]) >= threshold
            taken[i:] |= near

    def assign(self, lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first similar leader or -1, similarity) of every name."""
        order = np.argsort([len(s) for s in lowered], kind="stable")
        names = Names([lowered[i] for i in order])
        where = order
        leader = np.full(len(lowered), -1, dtype=np.int64)
        similarity = np.zeros(len(lowered), dtype=np.int64)
        free = np.ones(len(order), dtype=bool)
        for number, (_, seed) in enumerate(self.found):
            n = len(code_points(seed))
            start = int(np.searchsorted(names.lengths, np.floor(n * self.reach)))
            stop = len(free) if self.reach == 0 else int(
                np.searchsorted(names.lengths, np.ceil(n / self.reach), side="right"))
            if stop <= start or not free[start:stop].any():
                continue
            score = ratio(names.lcs(seed, start, stop), n, names.lengths[start:stop])
            hit = np.flatnonzero(free[start:stop] & (score >= self.threshold))
            leader[where[start + hit]] = number
            similarity[where[start + hit]] = score[hit]
            free[start + hit] = False
            if free.sum() * 2 < len(free):
                names.matrix = np.ascontiguousarray(names.matrix[:, free])
                names.lengths, where = names.lengths[free], where[free]
                free = np.ones(len(where), dtype=bool)
        return leader, similarity


def assign_to_block(block: list[tuple[str, str]], threshold: int):
    """``mapInPandas`` function: give every name its first similar leader out of the block.

    The block's leaders are found here, once, and not again in every task.
    """
    leaders = Leaders(block, threshold)
    titles = np.array([name for name, _ in leaders.found] + [None], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, score = leaders.assign(batch["low"].tolist())
            yield batch.assign(leader=titles[number], similarity=score)

    return run


# --- the first similar names before a name --------------------------------------------

LETTER_CLASSES, OCCURRENCES = 64, 16
_FIRST_SEEDS, _LAST_SEEDS = 32, 512


def least_lcs(total: np.ndarray, threshold: int) -> np.ndarray:
    """The smallest LCS with which names of ``total`` letters together reach the threshold."""
    guess = np.maximum(np.ceil((threshold - 0.5) / 200.0 * total).astype(np.int64) - 1, 0)
    for _ in range(3):
        guess = np.where(ratio(guess, total, 0) >= threshold, guess, guess + 1)
    return guess


def letter_tokens(sides: list[Texts]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side a 0/1 matrix of (letter, occurrence) tokens and the number of letters that are not in it.

    The product of two rows, plus the smaller of the two numbers left out, is at least the letters the names have in
    common, hence at least their LCS. Rare letters share classes and late occurrences are left out; both only raise it.
    """
    letters, counts = np.unique(np.concatenate([t.flat for t in sides]), return_counts=True)
    by_frequency = np.empty(len(letters), np.int64)
    by_frequency[np.argsort(-counts, kind="stable")] = np.arange(len(letters)) % LETTER_CLASSES
    found = []
    for texts in sides:
        row = np.repeat(np.arange(len(texts.lengths)), texts.lengths)
        kind = by_frequency[np.searchsorted(letters, texts.flat)]
        order = np.lexsort((kind, row))
        row, kind = row[order], kind[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])
        occurrence = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        inside = occurrence < OCCURRENCES
        rest = np.bincount(row[~inside], minlength=len(texts.lengths)).astype(np.float32)
        found.append((row[inside], (kind * OCCURRENCES + occurrence)[inside], rest))
    shared = np.zeros(LETTER_CLASSES * OCCURRENCES, np.int64) - 1
    both = np.intersect1d(np.unique(found[0][1]), np.unique(found[-1][1]))
    shared[both] = np.arange(len(both))
    out = []
    for texts, (row, token, rest) in zip(sides, found):
        matrix = np.zeros((len(texts.lengths), len(both)), np.float32)
        known = shared[token] >= 0
        matrix[row[known], shared[token[known]]] = 1.0
        out.append((matrix, rest))
    return out


def first_similar(seed_rank: np.ndarray, seeds: Texts, target_rank: np.ndarray, targets: Texts, after: np.ndarray,
                  threshold: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For every target its first ``keep`` similar seeds with ``after < seed rank < target rank``.

    Both sides are sorted by rank. Gives (target, seed, similarity) and the number of pairs that were compared letter by
    letter. Pairs are first bounded by the letters they have in common, a block of seeds at a time by one matrix product.
    """
    (s_matrix, s_rest), (t_matrix, t_rest) = letter_tokens([seeds, targets])
    slope = np.float32(max(threshold - 0.5, 0.0) / 200.0)
    one = np.ones((1, 1), np.float32)
    # Two more columns turn the product into letters in common minus letters needed.
    s_matrix = np.hstack([s_matrix, -slope * seeds.lengths[:, None].astype(np.float32), np.repeat(one, len(s_matrix), axis=0)])
    t_matrix = np.hstack([t_matrix, np.repeat(one, len(t_matrix), axis=0), -slope * targets.lengths[:, None].astype(np.float32)])
    rests = bool(s_rest.any() and t_rest.any())
    alive, found, hits, compared = np.arange(len(target_rank)), np.zeros(len(target_rank), np.int64), [], 0
    start, size = 0, _FIRST_SEEDS
    while start < len(seed_rank) and len(alive):
        rows = np.arange(start, min(start + size, len(seed_rank)))
        start, size = start + size, min(2 * size, _LAST_SEEDS)
        alive = alive[target_rank[alive] > seed_rank[rows[0]]]
        spare = s_matrix[rows] @ t_matrix[alive].T
        if rests:
            spare += np.minimum.outer(s_rest[rows], t_rest[alive])
        i, j = np.nonzero(spare > -0.05)
        i, j = rows[i], alive[j]
        wanted = (seed_rank[i] < target_rank[j]) & (seed_rank[i] > after[j])
        i, j = i[wanted], j[wanted]
        lcs = lcs_pairs(seeds, targets, i, j)
        compared += len(i)
        total = seeds.lengths[i] + targets.lengths[j]
        similar = lcs >= least_lcs(total, threshold)
        i, j, score = i[similar], j[similar], ratio(lcs[similar], total[similar], 0)
        order = np.lexsort((i, j))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)  # among this block's seeds
        few = found[j] + place < keep
        hits.append((j[few], i[few], score[few]))
        found += np.bincount(j, minlength=len(found))
        alive = alive[found[alive] < keep]
    if not hits:
        return (*(np.zeros(0, np.int64) for _ in range(3)), 0)
    return (*(np.concatenate(part) for part in zip(*hits)), compared)


def similar_before(threshold: int, keep: int):
    """Function for two cogrouped blocks, seeds (rank, low) and targets (target, text, after): (rank, other, similarity)."""

    def run(seeds: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        seeds, targets = seeds.sort_values("rank"), targets.sort_values("target")
        s, t = seeds["rank"].to_numpy(), targets["target"].to_numpy()
        j, i, score, _ = first_similar(s, Texts(seeds["low"]), t, Texts(targets["text"]), targets["after"].to_numpy(), threshold, keep)
        return pd.DataFrame({"rank": t[j], "other": s[i], "similarity": score})

    return run
