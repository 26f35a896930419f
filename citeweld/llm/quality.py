"""Quality of documents by a factorisation machine.

Features of a text: its hashed words (log counts, scaled to length one), statistics of its structure and its length.
Each feature has a weight and a short vector; two features add the product of their values and the inner product of
their vectors. All pairs together cost one pass: half of the square of the summed vectors less the sum of squares.

The machine is fitted on at most ``max_train`` labelled texts with ``max_features`` distinct words between them, the first
ones by a hash of their ids, and then scores every text in numpy batches. Neither label, language, source nor id is an input,
so the text's length in characters and words is all the metadata that is left to use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import give_back, ints, lists, tidy
from ..spark import cut
from ._spark import from_key, id_key, read, text_of
from ._words import U, Chunk, chunks

BUCKETS = 1 << 17
RANK = 8
MAX_TRAIN = 8000  # labelled texts to fit on, and
MAX_FEATURES = 4_000_000  # words in them, distinct within a text: bounds on what the driver holds (8 bytes a word)
EPOCHS = 8
STATS = ("log_chars", "log_words", "upper", "digit", "line", "stop", "symbol", "high", "length", "spread", "distinct", "top", "short", "long", "capital", "stopped")


def _classes() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)  # symbols
    kind[[9, 11, 12, 13, 32]] = 3
    kind[10] = 4
    kind[48:58] = 2
    kind[65:91] = 1
    kind[97:123] = 0
    for c in b".,;:?!'\"-()":
        kind[c] = 5
    kind[128:192] = 8  # the later bytes of a character
    kind[192:] = 7
    return kind


_KIND = _classes()


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of each distinct hashed word of a chunk, and a row of STATS for each text."""
    n = c.texts
    text = c.owner()
    keys, count = np.unique(text.astype(U) * U(BUCKETS) + (c.hash & U(BUCKETS - 1)), return_counts=True)
    who, bucket = (keys // U(BUCKETS)).astype(np.int64), (keys % U(BUCKETS)).astype(np.int64)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(who, value * value, n))
    value = value / norm[who]
    words = np.diff(c.off).astype(float)
    size = np.diff(c.bounds)
    kinds = np.bincount(np.repeat(np.arange(n) * 16, size) + _KIND[c.data], minlength=16 * n).reshape(n, 16)
    chars = np.maximum(kinds.sum(1) - kinds[:, 8], 1).astype(float)
    w = np.maximum(words, 1)
    length = (c.end - c.start).astype(float)
    mean = np.bincount(text, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(text, length * length, n) / w - mean * mean, 0))
    top = np.zeros(n)
    np.maximum.at(top, who, count)
    share = lambda flag: np.bincount(text, flag, n) / w
    first, last = (c.data[c.start], c.data[c.end - 1]) if len(c.start) else (np.zeros(0, np.uint8),) * 2
    stats = [np.log1p(chars), np.log1p(words), *(kinds[:, k] / chars for k in (1, 2, 4, 5, 6, 7)), mean, spread, np.bincount(who, minlength=n) / w, top / w, share(length <= 1), share(length > 12), share(_KIND[first] == 1), share(_KIND[last] == 5)]
    return who, bucket, value, np.stack(stats, 1)


class Machine:
    """Weights (one bias, one for each hashed word and statistic) and their vectors."""

    def __init__(self, bias: float, weight: np.ndarray, vector: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.bias, self.weight, self.vector, self.mean, self.scale = bias, weight, vector, mean, scale

    def raw(self, who: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and summed vectors of n texts from rows sorted by text."""
        linear = np.bincount(who, self.weight[at] * value, n) + self.bias
        vx = self.vector[at] * value[:, None].astype(np.float32)
        sums = np.zeros((n, self.vector.shape[1]), np.float64)
        squares = np.zeros(n)
        if len(who):
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            sums[who[start]] = np.add.reduceat(vx, start, axis=0)
            squares[who[start]] = np.add.reduceat((vx * vx).sum(1), start)
        return linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def join(self, who: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed words and scaled statistics as one list of features, sorted by text."""
        n, k = stats.shape
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        all_who = np.r_[who, np.repeat(np.arange(n), k)]
        order = np.argsort(all_who, kind="stable")
        return all_who[order], np.r_[bucket, np.tile(np.arange(k) + BUCKETS, n)][order], np.r_[value, z.reshape(-1)][order]


def fit(ptr: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    k = len(STATS)
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(stats) else (np.zeros(k), np.ones(k))
    share = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
    m = Machine(np.log(share / (1 - share)), np.zeros(BUCKETS + k), (rng.standard_normal((BUCKETS + k, rank)) * 0.02).astype(np.float32), mean, scale)
    seen_w, seen_v, seen_b = np.full(BUCKETS + k, 1e-6), np.full(BUCKETS + k, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            docs = order[at : at + 64]
            size = ptr[docs + 1] - ptr[docs]
            rows = np.repeat(ptr[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            who, feature, x = m.join(np.repeat(np.arange(len(docs)), size), bucket[rows], value[rows], stats[docs])
            odds, sums = m.raw(who, feature, x, len(docs))
            g = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label[docs]
            gw = g[who] * x
            gv = gw[:, None] * (sums[who] - m.vector[feature] * x[:, None])
            by = np.argsort(feature, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(feature[by]) != 0])
            own = feature[by][start]
            gw, gv = np.add.reduceat(gw[by], start) / len(docs), np.add.reduceat(gv[by], start, axis=0) / len(docs)
            gw += 1e-5 * m.weight[own]
            gv += 1e-5 * m.vector[own]
            seen_w[own] += gw * gw
            seen_v[own] += (gv * gv).mean(1)
            m.weight[own] -= 0.1 * gw / np.sqrt(seen_w[own])
            m.vector[own] -= (0.03 * gv / np.sqrt(seen_v[own])[:, None]).astype(np.float32)
            gb = g.mean()
            seen_b += gb * gb
            m.bias -= 0.05 * gb / np.sqrt(seen_b)
    return m


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b["text"], limit=1 << 20):
            who, bucket, value, stats = features(c)
            size = np.bincount(who, minlength=c.texts)
            part = b.slice(c.first, c.texts)
            yield pa.RecordBatch.from_arrays([part["did"], part["tie"], part["label"], pa.array(size), lists(bucket.astype(np.int32), size), lists(value.astype(np.float32), size), lists(stats.reshape(-1), np.full(c.texts, stats.shape[1]))], names=["did", "tie", "label", "n", "bucket", "value", "stats"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Fits a machine on the labelled rows of docs; labels has an id and a label of 0 or 1 (the largest of several counts).

    Rows without an id or a label are left out. Of an id that repeats, the text with the least ``xxhash64`` counts, once. Null
    texts are empty ones. Without any labelled text, so also with an empty table, every score is one half. Only the named
    columns are looked at. The features of labelled texts are kept as a table; the driver takes those of the first ids in the
    order of their hashes until one of the two bounds is reached.
    """
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("did")).agg(F.max(F.col(f"`{label_col}`").cast("long")).alias("label"))
    picked = known.orderBy(F.xxhash64("did"), "did").limit(max_train)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("did"), text_of(text_col).alias("text"))
    # max_train rows of two longs are the proven size of the broadcast side
    every = cut(texts.join(F.broadcast(picked), "did").select("did", F.xxhash64("text").alias("tie"), "label", "text").mapInArrow(tidy(_collect), "did long, tie long, label long, n long, bucket array<int>, value array<float>, stats array<double>"))
    one = every.groupBy("did").agg(F.min(F.struct("tie", "n")).alias("own")).select("did", "own.tie", "own.n")
    held = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("did"), "did"))  # of max_train rows at most
    chosen = one.withColumn("held", held).where(F.col("held") <= max_features).select("did", "tie")
    found = every.join(F.broadcast(chosen), ["did", "tie"]).dropDuplicates(["did"]).toArrow()
    if not found.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(STATS))), np.zeros(0))
    found = found.take(pa.array(np.argsort(ints(found["did"]), kind="stable"))).combine_chunks()  # rows come in any order; a fit can be repeated
    bucket, label = found["bucket"].combine_chunks(), ints(found["label"]).astype(float)
    ptr = np.r_[0, np.cumsum(bucket.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    stats = found["stats"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
    machine = fit(ptr, bucket.flatten().to_numpy(), found["value"].combine_chunks().flatten().to_numpy(), stats, label)
    del found, bucket, stats
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``carry`` columns and ``score`` (0 to 1, higher: label 1 likelier) of every row.

    Null texts are empty texts, which have a score too. Equal texts have equal scores. Columns other than those named are
    not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [f"_c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for c in chunks(b["text"], limit=1 << 20):
                who, bucket, value, stats = features(c)
                odds, _ = m.raw(*m.join(who, bucket, value, stats), c.texts)
                out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pa.RecordBatch.from_arrays([b["did"], *[b[x] for x in names], pa.array(np.concatenate(out) if out else np.zeros(0))], names=["did", *names, "score"])

    texts = docs.select(id_key(id_col).alias("did"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], text_of(text_col).alias("text"))
    kinds = "".join(f", {n} {docs.select(f'`{c}`').schema[0].dataType.simpleString()}" for c, n in zip(carry, names, strict=True))
    out = texts.mapInArrow(tidy(run), f"did long{kinds}, score double")
    return out.select(from_key("did").alias(id_col), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "score")


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % folds


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside fold 1 of 3; a null id is not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    machine = train(docs, labels.where(fold("doc_id", 3) != 1))
    out = score(docs, machine)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
