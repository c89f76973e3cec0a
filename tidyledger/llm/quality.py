"""Document quality by a byte-level convolutional network in numpy.

Every byte selects a row of a filter table for each place in a filter, so a
convolution over one-hot bytes is a sum of looked-up rows. A text is cut into
overlapping chunks that cover all of it. In every chunk the activations are
max-pooled and mean-pooled; a small hidden layer turns the pools of a chunk into
a chunk vector, chunk vectors are max-pooled and averaged over the document, and
one logistic unit combines them into a probability.

The network is trained on a bounded sample of labelled rows: those with the
smallest hashes of their ids, which the sample size as documented parameter bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import release, ship

WIDTH = 5
FILTERS = 16
HIDDEN = 12
CHUNK = 512
OVERLAP = 64
TRAINING_ROWS = 2000
TRAINING_BLOCK = 1024  # chunks whose activations training holds at once
EPOCHS = 3
BATCH = 48
PAD = 256  # byte value of the padding behind a text


@dataclass
class Network:
    """Parameters, by name so that training can walk over them."""

    parts: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        table = r.normal(0, 0.35, (WIDTH, PAD + 1, FILTERS)).astype(f)
        table[:, PAD] = 0
        return cls({
            "table": table, "bias": np.zeros(FILTERS, f),
            "w1": r.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f), "b1": np.zeros(HIDDEN, f),
            "w2": r.normal(0, 0.3, 2 * HIDDEN).astype(f), "b2": np.zeros(1, f)})


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping windows that cover every byte, padded behind the end; at least one."""
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def activations(net: dict, chunks: np.ndarray) -> np.ndarray:
    """Filter responses at every place of every chunk, before the bias."""
    places = CHUNK - WIDTH + 1
    out = net["table"][0].take(chunks[:, :places], axis=0)
    for j in range(1, WIDTH):
        out += net["table"][j].take(chunks[:, j:j + places], axis=0)
    return out


def pooled(net: dict, chunks: np.ndarray) -> tuple:
    """Max and mean pools of each chunk over the places that hold text, and what training needs of the way there."""
    act = activations(net, chunks)
    real = chunks[:, :act.shape[1]] != PAD
    count = np.maximum(real.sum(axis=1), 1).astype(np.float32)
    act += net["bias"]
    np.maximum(act, 0, out=act)
    act *= real[:, :, None]
    return np.concatenate([act.max(axis=1), act.sum(axis=1) / count[:, None]], axis=1), act, real, count


def document_vectors(net: dict, pools: np.ndarray, starts: np.ndarray) -> tuple:
    """Chunk vectors and their max and mean over each document; ``starts`` are the documents' first chunks."""
    hidden = np.tanh(pools @ net["w1"] + net["b1"])
    sizes = np.diff(np.append(starts, len(pools))).astype(np.float32)
    top = np.maximum.reduceat(hidden, starts, axis=0)
    mean = np.add.reduceat(hidden, starts, axis=0) / sizes[:, None]
    return hidden, top, np.concatenate([top, mean], axis=1), sizes


def probabilities(net: dict, texts: list[bytes], block: int = 256) -> np.ndarray:
    """One probability per text. Chunks go through the filters in bounded blocks, however long a text is."""
    parts = [chunks_of(t) for t in texts]
    pools = []
    for chunk_block in _blocks(parts, block):
        pools.append(pooled(net, chunk_block)[0])
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    vector = document_vectors(net, np.concatenate(pools), starts)[2]
    return 1 / (1 + np.exp(-(vector @ net["w2"] + net["b2"]).astype(np.float64)))


def _blocks(parts: list[np.ndarray], block: int) -> Iterator[np.ndarray]:
    waiting, n = [], 0
    for part in parts:
        for at in range(0, len(part), block):
            piece = part[at:at + block]
            waiting.append(piece)
            n += len(piece)
            if n >= block:
                yield np.concatenate(waiting)
                waiting, n = [], 0
    if waiting:
        yield np.concatenate(waiting)


def _gradients(net: dict, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray,
               block: int = TRAINING_BLOCK) -> dict:
    """Gradients of the loss of some documents. More chunks than a block go through the filters in blocks, a second time
    for the way back, so the activations in memory do not grow with the texts."""
    blocks = [slice(at, at + block) for at in range(0, len(chunks), block)]
    forward = pooled(net, chunks) if len(blocks) == 1 else None
    pools = forward[0] if forward else np.concatenate([pooled(net, chunks[b])[0] for b in blocks])
    hidden, top, vector, sizes = document_vectors(net, pools, starts)
    p = 1 / (1 + np.exp(-(vector @ net["w2"] + net["b2"])))
    d_out = ((p - y) * weight / len(y)).astype(np.float32)
    grads = {"w2": vector.T @ d_out, "b2": d_out.sum(keepdims=True)}
    d_vector = d_out[:, None] * net["w2"]
    owner = np.repeat(np.arange(len(starts)), sizes.astype(int))
    d_hidden = d_vector[owner, HIDDEN:] / sizes[owner, None] + d_vector[owner, :HIDDEN] * (hidden == top[owner])
    d_hidden *= 1 - hidden ** 2
    grads |= {"w1": pools.T @ d_hidden, "b1": d_hidden.sum(axis=0)}
    d_pools = d_hidden @ net["w1"].T
    grads |= {"bias": np.zeros_like(net["bias"]), "table": np.zeros_like(net["table"])}
    for b in blocks:
        _add_filter_gradients(grads, forward or pooled(net, chunks[b]), chunks[b], d_pools[b])
    grads["table"][:, PAD] = 0
    return grads


def _add_filter_gradients(grads: dict, forward: tuple, chunks: np.ndarray, d_pools: np.ndarray) -> None:
    _, act, real, count = forward
    d_act = (d_pools[:, FILTERS:] / count[:, None])[:, None, :] * (act > 0)
    d_act *= real[:, :, None]
    best = act.argmax(axis=1)
    rows, cols = np.indices(best.shape)
    d_act[rows, best, cols] += d_pools[:, :FILTERS] * (act[rows, best, cols] > 0)
    grads["bias"] += d_act.sum(axis=(0, 1))
    flat = d_act.reshape(-1, FILTERS)
    places = act.shape[1]
    for j in range(WIDTH):
        # Rows of equal bytes add up by sorting once; np.add.at is far slower.
        value = chunks[:, j:j + places].reshape(-1)
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.diff(value[order], prepend=-1))
        grads["table"][j][value[order][first]] += np.add.reduceat(flat[order], first, axis=0)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the log loss with both classes weighing the same. Every pass reads every text whole."""
    net = Network.fresh()
    share = max(labels.mean(), 1e-3), max(1 - labels.mean(), 1e-3)
    weights = np.where(labels == 1, 0.5 / share[0], 0.5 / share[1]).astype(np.float32)
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.parts.items()}
    second = {k: np.zeros_like(v) for k, v in net.parts.items()}
    step = 0
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            parts = []
            for i in some:
                parts.append(chunks_of(texts[i]))
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            grads = _gradients(net.parts, np.concatenate(parts), starts, labels[some], weights[some])
            step += 1
            rate = 0.02 * (1 - 0.95 * step / total)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.parts[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id):
    """Rows whose crc32 of the id as text is divisible by five; never trained on. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Network:
    """Train on at most ``rows`` labelled documents outside the held-out fold, whose text alone is read.

    Half of them are asked of each label, by the smallest hash of the id. Without
    both labels the network gives every text the share of label 1 (0.5 without any label).
    """
    known = labels.filter("quality in (0, 1)").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    chosen = known.filter("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2).unionAll(
        known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows - rows // 2))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(rows).select(
        "text", "quality").collect()
    y = np.array([row["quality"] for row in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net = Network.fresh()
        net.parts["w2"][:] = 0
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        net.parts["b2"][:] = np.log(share / (1 - share))
        return net
    return train([row["text"].encode("utf-8", "surrogatepass") for row in sample], y)


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """Add the probability of quality 1 of every whole text (null: empty). The network is some 100 kB, in the closure."""
    ship(docs.sparkSession)
    parts = net.parts

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            values = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts]
            yield pd.Series([p for at in range(0, len(values), 32)
                             for p in probabilities(parts, values[at:at + 32])], dtype="float64")

    return docs.withColumn(column, of("text"))


THRESHOLD = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3).

    Null and empty texts get the score of an empty text. Rows that repeat an id are scored each on their
    own text. No documents give no rows. Columns other than doc_id and text are never read.
    """
    net = fit(docs, labels, rows)
    return score(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    net = fit(docs, labels, rows)
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return score(packed, net).filter(F.col("score") >= THRESHOLD).select("row.*")
