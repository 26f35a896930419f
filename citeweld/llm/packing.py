"""Packing of documents into fixed windows by lexical retrieval.

Documents are dealt to shards by the term that weighs most in them, so that texts on one subject meet however large the
input is; what a shard takes in is bounded. A shard has a BM25 inverted index over its documents; the numbers of documents
with a term and the mean length that BM25 needs are counted over the whole table. A window starts with a seed document;
where the seed ends before the window does, the best unused neighbours of the seed follow until it is full, and a
neighbour that does not fit goes on in the next window, as its seed. Every window of a shard is full; what is left
at a shard's end goes into windows whose lengths are powers of two, so nothing is padded.

Ids are those of a tokenizer file, whose path is a parameter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark import cut
from ._arrow import ints, runs
from ._spark import from_key, id_key, read, text_of
from ._words import BLOCK, Chunk, U, chunks, hashes, mix, ranges

WINDOW = 1024
END_ID = 0  # follows each document
SHARD_BYTES = 4 << 20  # texts of a shard
TERMS = 1 << 18  # hashed terms of the index
K1, B = 1.2, 0.75

SLOTS = 20  # bits of the number of spans whose ids a worker remembers
MOST_IDS = 1 << 24  # ids of those spans
LONG = 256  # characters of a piece from which on the file's own library merges it, bytes of a span that is not remembered
DENSE = 4096  # documents of a shard up to which the frequent terms of all pairs are multiplied out
SHARE = 16  # a term is frequent that one of so many documents has

#: The ends of words that a byte-level BPE cuts off at an apostrophe.
_ONE, _TWO = "sdmt", ("ll", "ve", "re")
_tokenizers: dict[str, Coder] = {}


class Coder:
    """Ids of a tokenizer file.

    A plain byte-level BPE, whose merges are in the order of its ids, cuts a text into pieces that are merged for themselves.
    No piece crosses a blank but the space ahead of a word, so the ids of a word with that space are found once and remembered.
    Words not met before are cut into their pieces for many at once, and those are merged by a faster library with the same
    ranks, long ones by the file's own library. What kind a character is comes from the file's own library too; texts with blanks
    that do not end a word here are cut as a whole. Other files, and texts that hold a special token, go to that library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"].encode() for t in file.get("added_tokens", ())]
        self.between = 0  # the id of byte 0, which parts pieces on their way to the faster library
        self.ranked = self._ranked(file)
        # ids of spans met before: hash, place and number of ids at a slot for each hash, the latest span stays
        self.known = np.zeros((1 << SLOTS, 2), U)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def _ranked(self, file: dict) -> object | None:
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [model["vocab"][m] for m in merges]
        if order != sorted(set(order)):
            return None
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t.encode() not in self.special}
        if b"\0" not in ranks:
            return None
        self.between = ranks[b"\0"]
        return tiktoken.Encoding("ranked", pat_str=r"\x00|[^\x00]+", mergeable_ranks=ranks, special_tokens={})

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """LETTER, DIGIT, BLANK or OTHER for each character: those that the file's own library leaves in one piece are alike."""
        out = self.kinds[points]
        if (out == UNKNOWN).any():
            cut = self.own.pre_tokenizer.pre_tokenize_str
            for x in np.unique(points[out == UNKNOWN]).tolist():
                alike = (k for k, like in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(cut(like + chr(x))) == 1)
                self.kinds[x] = next(alike, BLANK)
            out = self.kinds[points]
        return out

    def _own(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of spans of data, each as a text of its own, their numbers, and which spans hold a blank that does not end a word."""
        spans = data[ranges(begin, size)]
        points = np.frombuffer(spans.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.r_[0, np.cumsum((spans & 0xC0) != 0x80)]  # characters before each byte
        bounds = first[np.r_[0, np.cumsum(size)]]
        kinds = self._kinds(points)
        odd = np.zeros(len(size), bool)
        odd[np.searchsorted(bounds, np.flatnonzero((kinds == BLANK) & (points != 32) & ((points < 9) | (points > 13))), "right") - 1] = True
        start, end = pieces(points, kinds, bounds)
        slow = end - start > LONG
        zeros = np.flatnonzero(points == 0)
        slow[np.searchsorted(start, zeros, "right") - 1] = True
        joined = np.insert(points, start, 0)
        if slow.any():
            rest = np.ones(len(joined), bool)
            number = np.flatnonzero(slow)
            rest[ranges(start[number] + number + 1, (end - start)[number])] = False
            joined = joined[rest]
        ids = np.array(self.ranked.encode_ordinary(joined.tobytes().decode("utf-32-le")), np.uint32)
        at = np.flatnonzero(ids == self.between)
        n = np.diff(np.r_[at, len(ids)]) - 1
        ids = ids[ids != self.between]
        if slow.any():
            late = [self._own(points[s:e].tobytes().decode("utf-32-le")) for s, e in zip(start[slow].tolist(), end[slow].tolist(), strict=True)]
            more = np.array([len(x) for x in late])
            ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[slow], more), np.concatenate(late))
            n[slow] = more
        before = np.r_[0, np.cumsum(n)]
        return ids, np.diff(before[np.searchsorted(start, bounds, "left")]), odd

    def _of_chunk(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk of at most BLOCK bytes, and their numbers."""
        start, end = spans(c)
        key = hashes(c.data, start, end)
        key[end - start > LONG] = 0  # never remembered
        slot = (key >> U(64 - SLOTS)).astype(np.int64)
        found = self.known.take(slot, 0)
        begin, size = (found[:, 1] >> U(16)).astype(np.int64), (found[:, 1] & U(0xFFFF)).astype(np.int64)
        new = np.flatnonzero((found[:, 0] != key) | (key == 0))
        whole = np.zeros(c.texts, bool)
        if len(new):
            own, first, back = np.unique(np.where(key[new] > 0, key[new], start[new].astype(U)), return_index=True, return_inverse=True)
            first = new[first]
            ids, n, odd = self._merged(c.data, start[first], end[first] - start[first])
            at = self.used + np.cumsum(n) - n
            self._keep(ids)
            begin[new], size[new] = at[back], n[back]
            kept = (key[first] > 0) & ~odd
            self.known[slot[first[kept]]] = np.stack([key[first[kept]], (at[kept] << 16 | n[kept]).astype(U)], 1)
            whole[np.searchsorted(c.bounds, start[new[odd[back]]], "right") - 1] = True
        if whole.any():  # their spans are replaced by one
            text = np.flatnonzero(whole)
            ids, n, _ = self._merged(c.data, c.bounds[text], c.bounds[text + 1] - c.bounds[text])
            at = self.used + np.cumsum(n) - n
            self._keep(ids)
            first = np.searchsorted(start, c.bounds[text], "left")
            size[whole[np.searchsorted(c.bounds, start, "right") - 1]] = 0
            begin[first], size[first] = at, n
        out = self.flat[ranges(begin, size)]
        per = np.diff(np.r_[0, np.cumsum(size)][np.searchsorted(start, c.bounds, "left")])
        if self.used > MOST_IDS:
            self.known[:], self.used = 0, 0
        return out, per

    def _keep(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), np.uint32)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk, one after another, and their numbers."""
        if self.ranked is not None and len(c.data) <= BLOCK:
            data = c.data.tobytes()
            if not any(s in data for s in self.special):
                return self._of_chunk(c) if len(data) else (np.zeros(0, np.uint32), np.zeros(c.texts, np.int64))
        each = [np.array(self._own(c.data[s:e].tobytes().decode()), np.uint32) for s, e in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True)]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def spans(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans of a chunk whose ids don't depend on what is around them: words with the space ahead of
    them, and what is left of the blanks, of which the last one is by itself if a word follows."""
    before = np.r_[0, c.end[:-1]] if len(c.end) else c.end
    some = np.flatnonzero(np.diff(c.off))  # texts with words
    before[c.off[some]] = c.bounds[some]
    joins = (c.start > before) & (c.data[c.start - 1] == 32)
    start = c.start - joins
    gap = np.flatnonzero(start > before)
    alone = gap[~joins[gap] & (start[gap] - before[gap] > 1)]
    last = c.bounds[:-1].copy()
    last[some] = c.end[c.off[some + 1] - 1]
    tail = last < c.bounds[1:]
    if not len(gap) and not tail.any():
        return start, c.end
    first = np.concatenate([start, before[gap], start[alone] - 1, last[tail]])
    order = np.argsort(first, kind="stable")
    first = first[order]
    return first, np.r_[first[1:], c.bounds[-1]]  # spans leave nothing out


LETTER, DIGIT, OTHER, BLANK, UNKNOWN = range(5)


def pieces(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that a byte-level BPE merges by themselves; bounds are those of the texts.

    A piece is a run of one kind. The last blank of a run goes with the piece behind it if it is a space, or else by itself,
    unless the text ends there. An apostrophe alone before letters takes the ends of words with it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kinds[1:] != kinds[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1].copy(), at[1:].copy()
    kind = kinds[start]
    last = np.zeros(n + 1, bool)
    last[bounds] = True
    goes_on = ~last[end]  # another run of the same text follows
    blank = (kind == BLANK) & goes_on
    joins = blank & (points[end - 1] == 32)
    alone = blank & ~joins & (end - start > 1)
    loose_start, loose_end = end[alone] - 1, end[alone].copy()
    end[joins | alone] -= 1
    taken = np.r_[False, joins[:-1]]
    # an apostrophe by itself, no space ahead of it, and letters behind
    follows = np.r_[kind[1:] == LETTER, False] & goes_on
    mark = np.flatnonzero((kind == OTHER) & (end - start == 1) & (points[start] == 39) & follows & ~taken)
    if len(mark):
        letters = end[mark + 1] - start[mark + 1]
        c1 = points[start[mark] + 1]
        c2 = np.where(letters > 1, points[np.minimum(start[mark] + 2, n - 1)], 0)
        more = np.isin(c1, [ord(c) for c in _ONE]).astype(np.int64)
        for a, b in _TWO:
            more[(c1 == ord(a)) & (c2 == ord(b))] = 2
        end[mark] += more
        start[mark + 1] += more
    start[taken] -= 1
    start, end = np.r_[start, loose_start], np.r_[end, loose_end]
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    some = end > start
    return start[some], end[some]


def coder(path: str) -> Coder:
    if path not in _tokenizers:
        _tokenizers[path] = Coder(path)
    return _tokenizers[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers."""
    out: list[bytes] = []
    for c in chunks(pa.array(texts, pa.large_string()), limit=BLOCK):
        ids, n = coder(path).ids(c)
        ids, at = ids.astype("<u4", copy=False).tobytes(), 4 * np.r_[0, np.cumsum(n)]
        out += [ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(TERMS, np.int64)
    docs = words = 0
    for b in batches:
        for c in chunks(b["text"], lower=True, limit=1 << 20):
            key = c.owner().astype(U) * U(TERMS) + (c.hash & U(TERMS - 1))
            key.sort()
            found += np.bincount((key[runs(key)[0]] & U(TERMS - 1)).astype(np.int64), minlength=TERMS)
            docs += c.texts
            words += len(c.hash)
    term = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[term, -1, -2]), pa.array(np.r_[found[term], docs, words])], names=["term", "n"])


def _heaviest(texts: pa.Array, idf: np.ndarray, mean: float) -> np.ndarray:
    """The term that weighs most in each text, among those that others have too; TERMS where there is none."""
    out = np.full(len(texts), TERMS, np.int64)
    for c in chunks(texts, lower=True, limit=1 << 20):
        key, tf = np.unique(c.owner().astype(U) * U(TERMS) + (c.hash & U(TERMS - 1)), return_counts=True)
        term, doc = (key & U(TERMS - 1)).astype(np.int64), (key // U(TERMS)).astype(np.int64)
        weight = idf[term] * tf / (tf + K1 * (1 - B + B * np.diff(c.off)[doc] / max(mean, 1e-9)))
        start, n = runs(doc)
        if len(start):
            best = weight == np.repeat(np.maximum.reduceat(weight, start), n)
            best &= np.repeat(np.maximum.reduceat(weight, start) > 0, n)
            out[doc[best][::-1] + c.first] = term[best][::-1]  # the least of equal ones
    return out


def _subjects(stats: object):
    """Rows with their heaviest term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_heaviest(b["text"], *stats.value[:2]))], names=[*b.schema.names, "term"])

    return run


def _dealt(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows (term, bytes, ...) with their shard: subjects lie one after another, small ones whole, texts of large ones at a place of
    their own, so that no shard takes in much more than shard_bytes, however large a subject is."""
    spark = rows.sparkSession
    sums = rows.groupBy("term").agg(F.sum("bytes").alias("n")).toArrow()  # TERMS rows and one
    weight = np.zeros(TERMS + 1, np.int64)
    weight[ints(sums["term"])] = ints(sums["n"])
    order = np.argsort(mix(np.arange(TERMS + 1, dtype=U)), kind="stable")
    begin = np.zeros(TERMS + 1, np.int64)
    begin[order] = np.cumsum(weight[order]) - weight[order]
    term = np.sort(ints(sums["term"]))
    spans = spark.createDataFrame(pa.table({"term": term, "begin": begin[term], "all": weight[term]}))
    place = F.shiftrightunsigned(F.xxhash64("did", "tie", "row"), 11) / F.lit(2.0**53)
    at = F.col("begin") + F.when(F.col("all") > shard_bytes // 4, F.floor(place * F.col("all"))).otherwise(F.lit(0))
    return rows.join(F.broadcast(spans), "term").withColumn("shard", F.floor(at / shard_bytes).cast("long"))  # three numbers for each of TERMS rows


def _by(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2**32, by their 16-bit halves."""
    order = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")
    high = (numbers >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Index:
    """BM25 over the documents of a shard."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
        self.docs = len(length)
        order = _by(term)
        self.posting_doc, self.posting_weight = doc[order], self.weight[order]
        self.first, self.size = runs(term[order])
        number = np.empty(len(term), np.int64)
        number[order] = np.repeat(np.arange(len(self.first)), self.size)
        self.frequent = self._frequent()
        if self.frequent is not None:
            number[self.frequent_term[number]] = -1
        by = np.arange(len(doc)) if (doc[1:] >= doc[:-1]).all() else _by(doc)
        by = by[number[by] >= 0]
        self.query_term = number[by]  # terms of each document, but for those multiplied out
        self.query_end = np.cumsum(np.bincount(doc[by], minlength=self.docs))

    def _frequent(self) -> np.ndarray | None:
        """What terms that are in many documents add to the score of each pair; other terms are looked up for each seed."""
        self.frequent_term = self.size * SHARE > self.docs
        number = np.flatnonzero(self.frequent_term)
        if not 1 < self.docs <= DENSE or not len(number):
            return None
        at = ranges(self.first[number], self.size[number])
        weights = np.zeros((len(number), self.docs), np.float32)
        weights[np.repeat(np.arange(len(number)), self.size[number]), self.posting_doc[at]] = self.posting_weight[at]
        return (weights > 0).astype(np.float32).T @ weights

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, by the BM25 score of all its terms, best first."""
        q = self.query_term[self.query_end[seed - 1] if seed else 0 : self.query_end[seed]]
        at = ranges(self.first[q], self.size[q])
        scores = np.bincount(self.posting_doc[at], self.posting_weight[at], self.docs)
        if self.frequent is not None:
            scores = scores + self.frequent[seed]
        scores[~unused] = 0
        while True:
            best = int(np.argmax(scores))
            if scores[best] <= 0:
                return
            scores[best] = 0
            yield best


def order_documents(lengths: np.ndarray, index: Index, window: int = WINDOW) -> list[int]:
    """Every document once, in the order in which windows are filled."""
    n = len(lengths)
    unused = np.ones(n, bool)
    out: list[int] = []
    fill, following = 0, 0
    seed = -1
    while len(out) < n:
        if seed < 0:  # no neighbour is left: the next unused document starts the window or goes on with it
            while not unused[following]:
                following += 1
            seed = following
            unused[seed] = False
            out.append(seed)
            fill = (fill + int(lengths[seed])) % window
        spilled = -1
        if fill:
            for d in index.neighbours(seed, unused):
                unused[d] = False
                out.append(d)
                room = window - fill
                fill = (fill + int(lengths[d])) % window
                if lengths[d] >= room:
                    spilled = d if lengths[d] > room else -1
                    break
        seed = spilled
    return out


def cuts(total: int, window: int = WINDOW) -> np.ndarray:
    """Where sequences end: full windows, then powers of two."""
    ends = list(range(window, total + 1, window))
    at = total // window * window
    rest = total - at
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, np.int64)


def _binary(tokens: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values of little-endian 32-bit numbers; value i starts at number at[i]."""
    raw = tokens.astype("<u4", copy=False)
    ends = np.r_[at, len(raw)]
    if 4 * len(raw) < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw)])
    return pa.array([raw[a:z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def _pack(path: str, window: int, end_id: int, stats: object, names: list[str]):
    def run(shard: pa.Table) -> pa.Table:
        idf, mean = stats.value[:2]
        shard = shard.combine_chunks()
        n = shard.num_rows
        order = np.lexsort((ints(shard["tie"]), ints(shard["did"])))
        shard = shard.take(pa.array(order)).combine_chunks()
        parts = []
        for c in chunks(shard["text"], lower=True, limit=1 << 20):
            ids, size = coder(path).ids(c)
            key, tf = np.unique(c.owner().astype(U) * U(TERMS) + (c.hash & U(TERMS - 1)), return_counts=True)
            parts.append(((key & U(TERMS - 1)).astype(np.int64), (key // U(TERMS)).astype(np.int64) + c.first, tf, np.diff(c.off), np.insert(ids, np.cumsum(size), end_id), size + 1))
        term, doc, tf, length, tokens, lengths = (np.concatenate([p[i] for p in parts]) for i in range(6))
        placed = np.array(order_documents(lengths, Index(term, doc, tf, length, idf, mean), window))
        size = lengths[placed]
        begin = np.cumsum(size) - size
        total = int(size.sum())
        ends = cuts(total, window)
        at = np.unique(np.r_[begin, ends[:-1]])  # a piece starts where a document or a sequence does
        stop = np.r_[at[1:], total]
        which = np.searchsorted(begin, at, "right") - 1
        sequence = np.searchsorted(ends, at, "right")
        start = at - begin[which]
        row = placed[which]
        tokens = tokens[ranges((np.cumsum(lengths) - lengths)[placed], size)]
        assert len(np.unique(placed)) == n
        base = int(shard["shard"][0].as_py()) << 40
        kept = shard.take(pa.array(row))
        seq_start = np.r_[0, ends][:-1]
        columns = {x: kept[x] for x in ["did", *names]}
        columns |= {"start": pa.array(start), "length": pa.array(stop - at), "ids": _binary(tokens, at), "doc_tokens": pa.array(lengths[row]), "sequence_id": pa.array(base + sequence), "offset": pa.array(at - seq_start[sequence])}
        return pa.table(columns)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each piece of a document in a sequence of at most ``window`` tokens.

    Returns ``id_col``, the ``carry`` columns, ``start`` (of the piece in its document), ``length``, ``ids`` (binary, 32-bit
    little-endian), ``doc_tokens``, ``sequence_id`` and ``offset`` (of the piece in its sequence). A document is its ids and
    ``end_id``; a null or empty text is that id alone. Each row of docs is a document, also where ids repeat or are null.
    Only the named columns are looked at; an empty table gives an empty result.

    Texts are read twice, once for the terms' counts and once for the heaviest term of each, and kept with that term. A shard's texts (about ``shard_bytes``, or one longer text) are packed by one task, and neighbours are looked for in
    it, not across shards: a text meets those with the same heaviest term (see README for how many of the best neighbours
    of a whole table that finds). The terms counted for BM25 are hashed to 2**18 numbers, which is what the driver and
    every task hold of them.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    names = [f"_c{i}" for i in range(len(carry))]
    texts = docs.select(id_key(id_col).alias("did"), F.xxhash64(text).alias("tie"), text.alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    counts = texts.select("text").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS rows and two
    term, n = ints(counts["term"]), ints(counts["n"])
    n_docs, n_words = int(n[term == -1].sum()), int(n[term == -2].sum())
    found = np.zeros(TERMS)
    found[term[term >= 0]] = n[term >= 0]
    idf = np.log1p((n_docs - found + 0.5) / (found + 0.5))
    shared = np.where(found > 1, idf, 0)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    mean = n_words / max(n_docs, 1)
    stats = spark.sparkContext.broadcast((idf, mean))
    kinds = "".join(f", {n} {docs.select(f'`{c}`').schema[0].dataType.simpleString()}" for c, n in zip(carry, names, strict=True))
    if shards == 1:
        dealt = texts.withColumn("shard", F.lit(0).cast("long"))
    else:
        subjects = spark.sparkContext.broadcast((shared, mean))
        heavy = texts.mapInArrow(_subjects(subjects), f"did long, tie long, text string{kinds}, term long")
        dealt = _dealt(cut(heavy.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("row", F.monotonically_increasing_id())), shard_bytes)
        dealt = dealt.select("did", "tie", "text", *names, "shard")
    out = dealt.groupBy("shard").applyInArrow(_pack(tokenizer, window, end_id, stats, names), f"did long{kinds}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.select(from_key("did").alias(id_col), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1,024 tokens of the public 50k byte-level BPE; see ``pack``."""
    import public_tokenizers

    out = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
