"""Quality classifier: a byte-level convolutional network in numpy.

``FILTERS`` learned filters, each ``WIDTH`` bytes wide, run over every byte of
a document.  Their answers are max-pooled over chunks of ``2 * BLOCK`` bytes
that overlap by half and cover the whole text; the pooled answers (rectified)
are averaged and maximised over the chunks of the document, and a logistic
output combines them into one probability.

Training reads a bounded sample: at most ``per_class`` labelled documents of
each class, in the order of a hash of their id, whole texts; those of more than
``longest`` bytes are not learned from.  The weights of the two classes restore
their share among all labels.  Scoring reads every
byte of every document, in blocks of bounded memory.

The filter bank is applied through tables of byte pairs (the answers of two
neighbouring columns added up beforehand), so a byte costs ``WIDTH / 2`` table
rows and no multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.llm.common import need, packed, parts_of, text_of, unpacked

FILTERS, WIDTH, BLOCK = 8, 4, 128
PER_CLASS, LONGEST = 1200, 1 << 17  # rows of a class, and bytes of a row, that training reads
STEPS, BATCH, RATE, SEED = 900, 32, 0.02, 7
AT_ONCE = 1 << 18  # bytes whose filter answers are held at a time


def blocks_of(raw: bytes) -> np.ndarray:
    """The bytes of a text, followed by at least ``WIDTH`` zero bytes, filled
    up to whole blocks."""
    n = -(-(len(raw) + WIDTH) // BLOCK) * BLOCK
    out = np.zeros(n, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


class Network:
    """Filters ``w`` (WIDTH, 256, FILTERS), their bias ``b`` and the output
    weights ``v`` (for the mean, then the maximum over chunks) and ``c``."""

    def __init__(self, seed: int = SEED, start: float = 0.0):
        r = np.random.default_rng(seed)
        self.w = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = r.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.c = np.float32(start)

    def tables(self) -> list[np.ndarray]:
        """For each pair of columns the answers to all 65,536 byte pairs."""
        return [(self.w[k][:, None, :] + self.w[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def answers(self, data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Filter answers at each byte of ``data`` but the last ``WIDTH - 1``."""
        pairs = (data[:-1].astype(np.intp) << 8) | data[1:]
        n = len(data) - WIDTH + 1
        out = tables[0][pairs[:n]]
        for k, t in enumerate(tables[1:], 1):
            out += t[pairs[2 * k : 2 * k + n]]
        return out

    def pooled(self, data: np.ndarray, tables: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each block; ``ends`` are the ends
        of the documents."""
        out = []
        for at in range(0, len(data), AT_ONCE):
            part = data[at : at + AT_ONCE + WIDTH - 1]
            if len(part) < WIDTH or at + AT_ONCE >= len(data):  # the end: what follows counts as zero bytes
                part = np.concatenate([data[at : at + AT_ONCE], np.zeros(WIDTH - 1, np.uint8)])
            a = _closed(self.answers(part, tables), ends[(ends > at) & (ends <= at + AT_ONCE)] - at)
            out.append(a.reshape(-1, BLOCK, FILTERS).max(axis=1))
        return np.concatenate(out)

    def features(self, pooled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean and maximum over chunks; ``sizes`` are the blocks per document."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        chunk = pooled.copy()
        inner = np.ones(len(pooled), bool)
        inner[ends - 1] = False  # a chunk does not reach into the next document
        at = np.flatnonzero(inner)
        chunk[at] = np.maximum(pooled[at], pooled[at + 1])
        act = np.maximum(chunk + self.b, 0)
        mean = np.add.reduceat(act, starts, axis=0, dtype=np.float64) / sizes[:, None]
        return np.concatenate([mean, np.maximum.reduceat(act, starts, axis=0)], axis=1)

    def probability(self, raws: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        """One probability per text."""
        out, group, held = [], [], 0
        for i, raw in enumerate(raws):
            group.append(blocks_of(raw))
            held += len(group[-1])
            if held >= 8 * AT_ONCE or i == len(raws) - 1:
                sizes = np.array([len(x) // BLOCK for x in group])
                x = self.features(self.pooled(np.concatenate(group), tables, np.cumsum(sizes) * BLOCK), sizes)
                out.append(1 / (1 + np.exp(-np.clip(x @ self.v + self.c, -30, 30))))
                group, held = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def _closed(answers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A text ends with ``WIDTH`` zero bytes or more: filters that start among
    the last of them answer as on zero bytes, not as on the next text."""
    for k in range(1, WIDTH):
        answers[ends - k] = answers[ends - WIDTH]
    return answers


def train(raws: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the weighted log loss; the gradient of a pooled answer goes to
    the bytes at which the filter answered most."""
    mean = float(np.average(labels, weights=weights))
    net = Network(seed, np.log(mean / (1 - mean)))
    docs = [blocks_of(r) for r in raws]
    names = ("w", "b", "v", "c")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    r, step = np.random.default_rng(seed), 0
    while step < STEPS:
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / STEPS))
        order = r.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            data = np.concatenate([docs[i] for i in pick] + [np.zeros(WIDTH - 1, np.uint8)])
            sizes = np.array([len(docs[i]) // BLOCK for i in pick])
            a = _closed(net.answers(data, net.tables()), np.cumsum(sizes) * BLOCK).reshape(-1, BLOCK, FILTERS)
            where = a.argmax(axis=1) + BLOCK * np.arange(len(a))[:, None]
            pooled = a.max(axis=1)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            last = np.zeros(len(pooled), bool)
            last[ends - 1] = True
            follow = np.where(last, np.arange(len(pooled)), np.arange(len(pooled)) + 1)
            other = pooled[follow] > pooled
            chunk = np.where(other, pooled[follow], pooled)
            where = np.where(other, where[follow], where)
            act = np.maximum(chunk + net.b, 0)
            x = np.concatenate([np.add.reduceat(act, starts, axis=0) / sizes[:, None], np.maximum.reduceat(act, starts, axis=0)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ net.v + net.c, -30, 30)))
            g = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            owner = np.repeat(np.arange(len(pick)), sizes)
            top = act == np.maximum.reduceat(act, starts, axis=0)[owner]
            share = top / np.add.reduceat(top, starts, axis=0)[owner]
            up = g[owner, None] * (net.v[:FILTERS] / sizes[owner, None] + net.v[FILTERS:] * share) * (act > 0)
            grad = {"v": x.T @ g, "c": g.sum(), "b": up.sum(axis=0), "w": np.zeros_like(net.w)}
            column = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(grad["w"][k], (data[where + k], column), up)
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = PER_CLASS, longest: int = LONGEST) -> Network | float:
    """Train on at most ``per_class`` labelled rows per class, none of more than
    ``longest`` bytes, so at most the product of both reaches the driver.

    Rows without a label, with a label other than 0 and 1, or held out are not
    learned.  If fewer than two documents of either class are left, the answer
    is a constant: the share of label 1, smoothed.
    """
    need(docs, id_col, text_col)
    usable = labels.select(F.col(id_col).alias("_t_id"), F.col(label_col).cast("int").alias("_t_y")).where(
        F.col("_t_id").isNotNull() & F.col("_t_y").isin(0, 1) & ~held_out("_t_id")
    )
    n = {y: k for y, k in usable.groupBy("_t_y").count().collect()}
    rows = []
    for y in (0, 1):
        order = [F.xxhash64("_t_id"), F.col("_t_id")]
        chosen = usable.where(F.col("_t_y") == y).orderBy(*order).limit(per_class)  # bounds the broadcast
        found = docs.select(F.col(id_col).alias("_t_id"), text_of(text_col).alias("_t_text")).join(F.broadcast(chosen), "_t_id")
        found = found.where(F.octet_length("_t_text") <= longest)
        rows += found.orderBy(*order, "_t_text").limit(per_class).select("_t_text", "_t_y").collect()
    y = np.array([r["_t_y"] for r in rows], np.float32)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    share = {k: n[k] / max(1, int((y == k).sum())) for k in (0, 1)}
    weights = np.array([share[int(k)] for k in y], np.float32)
    return train([r["_t_text"].encode() for r in rows], y, weights / weights.mean())


def score(spark: SparkSession, docs: DataFrame, net: Network | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` added: the probability of label 1 of the whole
    text (null and empty texts are scored as the empty text)."""
    need(docs, text_col)
    if isinstance(net, float):
        return docs.withColumn(name, F.lit(net))
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        tables = net.tables()
        for part in parts_of(texts):
            yield pd.Series(net.probability([t.encode() for t in part], tables), dtype="float64")

    return docs.withColumn(name, probability(text_of(text_col)))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``docs`` whose score is at least ``least``, columns unchanged."""
    net = fit(docs, labels, id_col, text_col)
    rows = packed(docs).withColumn("_t_text", F.col("_t_doc")[text_col])
    return unpacked(score(spark, rows, net, "_t_text", "_t_score").where(F.col("_t_score") >= least))
