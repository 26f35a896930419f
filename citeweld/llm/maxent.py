"""Scores of a hashed maximum-entropy language model.

The model gives the next token by two softmaxes: its class, and within the class its slot, to which words are hashed:
P(token | history) = P(class | history) * P(slot | class, history) * P(token | class, slot). The last factor parts the words
that share a slot by smoothed counts, so words are unbounded and the probabilities of all words still add up to one. A class
is a hash of a word's last letters; the end of a text is a class of its own and needs no slot. Both softmaxes have a
bias and hashed features of the history: the word before (a bigram), the word before that (a skip) and both together (a
trigram); those of a slot go with its class. All features share 2**16 rows of 16 weights.

Training: each round sends the weights to all tasks; a task goes over its training texts in batches of sparse
gradients (AdaGrad), which touch the rows of their features only, and returns how far its weights moved; moves are
averaged by tokens, block of weights by block.

Counting: texts are dealt into chunks once. A chunk's distinct words go to the words' totals, which send back what the
chunk cannot know; then the chunk scores its texts against that table. So neither a vocabulary is broadcast nor is
every token shuffled, and a very frequent word sends a row from each chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark import cut
from ._arrow import ints, runs, whole_groups
from ._spark import from_key, id_key, read, text_of
from ._words import U, Chunk, chunks, mix
from .quality import fold

CLASSES = 16  # class 0 is the end of a text
SLOTS = 16  # of a class
WIDTH = max(CLASSES, SLOTS)  # weights of a row
KINDS = CLASSES * SLOTS  # a token's kind is its class and slot
HASH_BITS = 16  # features have so many bits
BIAS = 1 << HASH_BITS  # the row of the classes' bias; row BIAS + 1 + k is that of the slots of class k
BLOCK = 256  # rows of weights that travel together
ROWS = BIAS + BLOCK  # rows of weights
LAYERS = 4  # gradients of a row that are added one by one
ROUNDS = 2
RATE = 0.4
BATCH = 8_192  # tokens of a gradient
SPREAD = 0.25  # share of a gradient's square that slows its row down
LIMIT = 15.0  # of a weight
CHUNK_BYTES = 8 << 20
ADD = 0.1  # smoothing of counts
END = U(0x5851F42D4C957F2D)  # stands for the end of a text


@functools.cache
def _first_kinds() -> np.ndarray:
    """The kind of the first slot of a word's class, by its last byte * 256 and the one before that."""
    byte = np.arange(256, dtype=U)
    byte[65:91] += U(32)
    group = 1 + mix((byte[:, None] * U(256) + byte).ravel()) % U(CLASSES - 1)
    return (group * U(SLOTS)).astype(np.int64)


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk and an end after each text: hashes, kinds (class * SLOTS + slot) and the text of each token."""
    n = c.texts
    per = np.diff(c.off)
    at = np.arange(len(c.hash)) + c.owner()
    total = len(c.hash) + n
    h, kind, text = np.full(total, END, U), np.zeros(total, np.int64), np.repeat(np.arange(n), per + 1)
    h[at] = c.hash
    if len(c.hash):
        ending = c.data.take(c.end - 1).astype(np.intp) << 8
        ending += np.where(c.end - c.start > 1, c.data.take(np.maximum(c.end - 2, 0)), 0)
        own = (mix(c.hash + U(77)) % U(SLOTS)).astype(np.int64)
        own += _first_kinds().take(ending)
        kind[at] = own
    return h, kind, text


def history(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of what is known before each token: the word before, the one before that, and both."""
    one, two = np.full_like(h, U(1)), np.full_like(h, U(2))
    one[1:] = np.where(text[1:] == text[:-1], h[:-1], U(1))
    two[2:] = np.where(text[2:] == text[:-2], h[:-2], U(2))
    one, two = mix(one + U(11)), mix(two + U(22))
    return np.stack([one, two, mix(one + two * U(3))])


def rows_of(past: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights that are active before each token, of its class or (with ``group``, its class) of its slot: bias and features."""
    if group is None:
        bias = np.full(past.shape[1], BIAS)
    else:
        bias = BIAS + 1 + group
        past = mix(past + mix(group.astype(U) + U(33)))
    return bias, (past >> U(64 - HASH_BITS)).astype(np.int64)


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the active weights; weights stay within LIMIT, so no exponential of a sum overflows."""
    z = weights.take(bias, 0)
    for r in rows:
        z += weights.take(r, 0)
    return z


def log_choice(weights: np.ndarray, active: tuple[np.ndarray, np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Natural log of the probability of what was chosen before each token."""
    z = logits(weights, *active)
    own = z.ravel().take(places(chosen)).astype(float)
    return own - np.log(np.exp(z, out=z) @ np.ones(WIDTH, np.float32))


def places(chosen: np.ndarray) -> np.ndarray:
    """Where the chosen ones of rows of WIDTH numbers lie, row after row."""
    return np.arange(0, len(chosen) * WIDTH, WIDTH) + chosen


def log_kind(weights: np.ndarray, past: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's class and slot."""
    group = kind // SLOTS
    out = log_choice(weights, rows_of(past), group)
    word = np.flatnonzero(group)
    group = group.take(word)
    out[word] += log_choice(weights, rows_of(past.take(word, 1), group), kind.take(word) - group * SLOTS)
    return out


def row_sums(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their gradients and how many those are; gradient i is g[i % len(g)].

    Most rows have few gradients: the first ones are added layer by layer, all rows at once, and what a row has more of them in one sum.
    """
    n = len(g)
    order = np.argsort(rows.astype(np.uint16 if HASH_BITS <= 16 else np.uint32), kind="stable")
    start, often = runs(rows.take(order))
    at = rows.take(order.take(start))
    order = np.tile(np.arange(n), -(-len(rows) // n)).take(order)
    sums = g.take(order.take(start), 0)
    more = np.flatnonzero(often > 1)
    if len(more):
        often_more = often.take(more)
        by = np.argsort(np.maximum(LAYERS + 1 - often_more, 0).astype(np.uint8), kind="stable")  # rows with most gradients come first
        more, often_more = more.take(by), often_more.take(by)
        first = start.take(more)
        have = np.cumsum(np.bincount(np.minimum(often_more, LAYERS + 1), minlength=LAYERS + 2)[::-1])[::-1]  # rows of at least so many
        sum_more = sums.take(more, 0)
        for layer in range(1, LAYERS):
            m = have[layer + 1]
            sum_more[:m] += g.take(order.take(first[:m] + layer), 0)
        m = have[LAYERS + 1]
        if m:
            size = often_more[:m] - LAYERS
            begin = np.cumsum(size) - size
            rest = np.repeat(first[:m] + LAYERS - begin, size) + np.arange(size.sum())
            sum_more[:m] += np.add.reduceat(g.take(order.take(rest), 0), begin, 0)
        put_rows(sums, more, sum_more)
    return at, sums, often


def put_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each copied as one value."""
    whole = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(whole).ravel()[at] = rows.view(whole).ravel()


class Trainer:
    """Weights that move along the gradients of one task."""

    def __init__(self, weights: np.ndarray) -> None:
        self.w = weights.copy()
        self.seen = np.ones(len(weights), np.float32)
        self.count = 0

    def step(self, past: np.ndarray, kind: np.ndarray) -> None:
        self.count += len(kind)
        group = kind // SLOTS
        self._learn(*rows_of(past), group)
        word = np.flatnonzero(group)
        if len(word):
            group = group.take(word)
            self._learn(*rows_of(past.take(word, 1), group), kind.take(word) - group * SLOTS)

    def _learn(self, bias: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
        g = logits(self.w, bias, rows)
        np.exp(g, out=g)
        g /= (g @ np.ones(WIDTH, np.float32))[:, None]
        n = len(chosen)
        g.ravel()[places(chosen)] -= 1
        self._move(*row_sums(g, rows.ravel()))
        if (bias == bias[0]).all():
            self._move(bias[:1], np.ones((1, n), np.float32) @ g, np.array([n]))
        else:
            own = np.eye(CLASSES + 1, dtype=np.float32).take(bias - BIAS, 0)
            often = np.bincount(bias - BIAS, minlength=CLASSES + 1)
            some = np.flatnonzero(often)
            self._move(BIAS + some, (own.T @ g)[some], often[some])

    def _move(self, at: np.ndarray, by: np.ndarray, often: np.ndarray) -> None:
        """One step of the rows ``at``, whose gradients sum to ``by`` over ``often`` tokens; a row's weights share a rate."""
        seen = self.seen.take(at)
        seen += np.einsum("ij,ij->i", by, by) / often.astype(np.float32) * np.float32(SPREAD)
        self.seen[at] = seen
        by *= (np.float32(RATE) / np.sqrt(seen * often.astype(np.float32)))[:, None]
        w = self.w.take(at, 0)
        w -= by
        put_rows(self.w, at, np.clip(w, -LIMIT, LIMIT, out=w))


def _gradients(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        t = Trainer(start)
        for b in batches:
            for c in chunks(b["text"], lower=True, limit=1 << 20):
                h, kind, text = tokens(c)
                past = history(h, text)
                for at in range(0, len(h), BATCH):
                    t.step(past[:, at : at + BATCH], kind[at : at + BATCH])
        if t.count:
            moved = ((t.w - start) * np.float32(t.count)).reshape(ROWS // BLOCK, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moved))), pa.array([m.tobytes() for m in moved], pa.binary()), pa.array(np.full(len(moved), t.count))], names=["block", "moved", "n"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of moves block by block; rows come sorted by block."""
    block, total, n = None, None, 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([block]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["block", "moved"])
    for b in batches:
        for k, moved, m in zip(ints(b["block"]).tolist(), b["moved"], ints(b["n"]).tolist(), strict=True):
            if k != block:
                if block is not None:
                    yield done()
                block, total, n = k, np.zeros(BLOCK * WIDTH), 0
            total += np.frombuffer(moved.as_buffer(), np.float32)
            n += m
    if block is not None:
        yield done()


def train(texts: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (ROWS x WIDTH) fitted on all rows of texts, which has a column ``text``."""
    weights = np.zeros((ROWS, WIDTH), np.float32)
    sc = texts.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(weights)
        moves = texts.select("text").mapInArrow(_gradients(shared), "block long, moved binary, n long").repartition("block").sortWithinPartitions("block").mapInArrow(_average, "block long, moved binary")
        got = moves.toArrow()  # the weights: a fixed size
        weights = weights.copy()
        for k, moved in zip(got["block"].to_pylist(), got["moved"].to_pylist(), strict=True):
            weights[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(moved, np.float32).reshape(BLOCK, WIDTH)
    return weights


class Found:
    """The tokens of a chunk's texts, found once; ``at`` gives each its place among the distinct ones."""

    def __init__(self, chunk: pa.Table, learn: np.ndarray) -> None:
        parts = [(c.first, *tokens(c)) for c in chunks(chunk["text"], lower=True, limit=1 << 20)]
        self.hash, self.kind = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        self.text = np.concatenate([first + text for first, _, _, text in parts])
        self.word, self.at = np.unique(self.hash, return_inverse=True)  # sorted as unsigned numbers
        self.kind_of = np.zeros(len(self.word), np.int64)
        self.kind_of[self.at] = self.kind
        self.count = np.bincount(self.at, learn[self.text], len(self.word)).astype(np.int64)


def _words(chunk: pa.Table) -> pa.Table:
    """Distinct tokens of a chunk, their kinds and their counts in its training texts."""
    chunk = chunk.combine_chunks()
    f = Found(chunk, ~ints(chunk["held_out"], bool))
    return pa.table({"word": f.word.view(np.int64), "kind": f.kind_of.astype(np.int32), "n": f.count, "chunk": np.full(len(f.word), chunk["chunk"][0].as_py(), np.int64)})


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by word. For chunks: the totals that differ from their own count. With chunk -1: sums by kind."""
    count, distinct = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for t in whole_groups(batches, "word"):
        word, kind, n, chunk = (ints(t[c]) for c in ("word", "kind", "n", "chunk"))
        start, size = runs(word)
        total = np.add.reduceat(n, start)
        count += np.bincount(kind[start], total, KINDS).astype(np.int64)
        distinct += np.bincount(kind[start], total > 0, KINDS).astype(np.int64)
        c = np.repeat(total, size)
        tell = c != n
        yield pa.RecordBatch.from_arrays([pa.array(chunk[tell]), pa.array(word[tell]), pa.array(c[tell]), pa.array(np.zeros(tell.sum(), np.int64))], names=["chunk", "word", "c", "v"])
    yield pa.RecordBatch.from_arrays([pa.array(np.full(KINDS, -1)), pa.array(np.arange(KINDS)), pa.array(count), pa.array(distinct)], names=["chunk", "word", "c", "v"])


SCORED = "did long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shared: object):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        names = ["did", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        texts = texts.combine_chunks()
        f = Found(texts, ~ints(texts["held_out"], bool))
        count = f.count
        if told.num_rows:
            count[np.searchsorted(f.word, ints(told["word"]).view(U))] = ints(told["c"])
        weights, by_kind, every = shared.value
        logs = np.log10(count + ADD)[f.at]
        past = history(f.hash, f.text)
        likely = np.concatenate([log_kind(weights, past[:, at : at + BATCH], f.kind[at : at + BATCH]) for at in range(0, len(f.hash), BATCH)])
        per = lambda values=None: np.bincount(f.text, values, texts.num_rows)
        return pa.Table.from_arrays([texts["did"], texts["held_out"], *map(lambda x: pa.chunked_array([x]), (per(), per((count > 0)[f.at]).astype(np.int64), per(logs - every), per(likely / np.log(10) + logs - by_kind[f.kind])))], names=names)

    return run


def language_scores(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every text under a model of the texts outside fold 0 of ``folds`` (by crc32 of the id as text).

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (log10 probability under
    smoothed counts) and ``score`` (under the model). A null text is empty and has one token, its end; a null id is learnt
    from. Every row is a text of its own, also where ids or texts repeat. Other columns are not looked at; an empty table
    gives an empty result. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(id_key(id_col).alias("did"), text.alias("text"), F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out"))
    weights = train(texts.where(~F.col("held_out")), rounds)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // chunk_bytes))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("did", "text"), F.lit(n)).cast("long"))
    words = dealt.groupBy("chunk").applyInArrow(_words, "word long, kind int, n long, chunk long")
    totals = cut(words.repartition("word").sortWithinPartitions("word").mapInArrow(_totals, "chunk long, word long, c long, v long"))
    count, distinct = np.zeros(KINDS), np.zeros(KINDS)
    for r in totals.where("chunk < 0").groupBy("word").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # a row for each kind
        count[r.word], distinct[r.word] = r.c, r.v
    n_train, n_distinct = int(count.sum()), int(distinct.sum())
    log_size = lambda c, v: np.log10(c + ADD * (v + 1))
    shared = spark.sparkContext.broadcast((weights, log_size(count, distinct), float(log_size(n_train, n_distinct))))
    scored = dealt.groupBy("chunk").cogroup(totals.where("chunk >= 0").groupBy("chunk")).applyInArrow(_score(shared), SCORED)
    return scored.select(from_key("did").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op6_maximum_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those outside fold 0 of 10; see ``language_scores``."""
    return language_scores(read(spark, sf_dir, "documents"))
