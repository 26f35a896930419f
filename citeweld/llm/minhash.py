"""Near-duplicate documents by b-bit MinHash.

A text is the set of its five-word shingles. Texts with one set are one class, found by a 128-bit print of the set.
Each class has 128 minima: bands of some of them, 25 of five at a threshold of 0.85, propose candidates, and the low four bits of all of them, packed
into 64 bytes, estimate the similarity of a candidate by bit counts, corrected for low bits that agree by chance.
Estimates far below the threshold end a candidate; all others are confirmed on the full sets.

A pair at the threshold shares no band with a chance of at most 5e-7; bands and margins follow from it. Buckets are compared in three rounds. In the
first, each member meets the bucket's least member only; that links whole groups of copies. In the second, members of
a bucket that are in different components meet those that look most alike; that gathers the outlying copies. In the
third, those that are still apart meet each other in blocks of bounded size, and 1,024 minima of each decide which
pairs are confirmed on the full sets. So no link between components is lost, and a group of m copies costs a few times
m confirmations instead of m * m. Components are found of the first round's links; from then on links join components,
so the graph that later rounds leave is as small as what they find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import batch, ints, lists, runs, whole_groups
from ..spark import components, cut
from ._spark import from_key, id_key, read, text_of
from ._words import U, WORD_BASE, Chunk, chunks, grams, mix, ranges

SHINGLE = 5  # words of a shingle
HASHES = 128
MISS = 5e-7  # chance that a pair at the threshold shares no band
MOST_ROWS = 8  # minima of a band
BITS = 4  # low bits that are kept of each minimum
PERCENT = 85  # of the union that the intersection has to reach
DEVIATIONS = 5.5  # an estimate so many standard deviations below the threshold ends a candidate
BLOCK = 2048  # rows of a bucket that meet at once
BEST = 2  # partners that a member meets in the second round
FINE = 1024  # minima of the third round

_MULTIPLIERS = mix(np.arange(1, FINE + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and minima of a band: the most minima at which a pair at the threshold is missed with a chance of MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent has to be in 1 .. 100, not {percent}")
    for rows in range(MOST_ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log(apart)) if apart else 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"{HASHES} minima are too few to find pairs at {percent} percent")


def floor_for(percent: int, hashes: int) -> float:
    """Estimate from so many minima that a pair at the threshold does not fall below."""
    chance = 1 / (1 << BITS)
    same = chance + (1 - chance) * percent / 100
    return percent / 100 - DEVIATIONS * math.sqrt(same * (1 - same) / hashes) / (1 - chance)


def shingle_sets(c: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text of a chunk, one after another, and how many each has."""
    g = grams(c.hash, k)
    sets, sizes = [], np.zeros(c.texts, np.int64)
    for i, (a, z) in enumerate(zip(c.off[:-1].tolist(), c.off[1:].tolist(), strict=True)):
        if z - a >= k:
            own = np.unique(g[a : z - k + 1])
        elif z > a:  # the whole sequence is the only shingle
            acc = U(z - a)
            with np.errstate(over="ignore"):
                for w in c.hash[a:z]:
                    acc = acc * WORD_BASE + w
            own = mix(np.array([acc], U))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), sizes


def minima(sets: np.ndarray, starts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """So many minima of each set (starts: where it begins)."""
    out = np.empty((len(starts), hashes), U)
    if len(starts):
        for i in range(hashes):
            out[:, i] = np.minimum.reduceat(sets * _MULTIPLIERS[i], starts)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 16 to a word of 64 bits."""
    low = (least & U((1 << BITS) - 1)).reshape(len(least), least.shape[1] * BITS // 64, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=U) * U(BITS)), axis=2)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for chance: low bits agree by chance once in 2**BITS."""
    x = a ^ b
    x = x | (x >> U(1))
    x = (x | (x >> U(2))) & U(0x1111111111111111)
    hashes = x.shape[-1] * 64 // BITS
    same = (hashes - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)) / hashes
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def _describe(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tie = ints(b["did"]), ints(b["tie"])
            for c in chunks(b["text"], lower=True, limit=1 << 19):
                sets, sizes = shingle_sets(c)
                full = np.flatnonzero(sizes)
                start = (np.cumsum(sizes) - sizes)[full]
                least = minima(sets, start)
                keys = np.empty((len(full), bands), U)
                for i in range(bands):
                    acc = np.full(len(full), i + 1, U)
                    for j in range(rows):
                        acc = acc * WORD_BASE + least[:, i * rows + j]
                    keys[:, i] = mix(acc)
                n = c.texts
                prints = np.zeros((2, n), U)
                if len(full):
                    prints[0, full] = np.add.reduceat(mix(sets), start)
                    prints[1, full] = np.add.reduceat(mix(sets ^ U(0xD1B54A32D192ED03)), start)
                sign = pa.array([None] * n, pa.binary()) if not len(full) else _binary(signatures(least), sizes > 0)
                yield batch(did=did[c.first : c.first + n], tie=tie[c.first : c.first + n], n_shingles=sizes, print1=prints[0].view(np.int64), print2=prints[1].view(np.int64), bands=lists(keys.reshape(-1).view(np.int64), np.where(sizes > 0, bands, 0)), signature=sign)

    return run


def _binary(rows: np.ndarray, there: np.ndarray) -> pa.Array:
    """A binary column with a row of bytes where there is one, else an empty value."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.zeros(len(there) + 1, np.int32)
    np.cumsum(np.where(there, width, 0), out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # rows that repeat an id and a text meet in one partition
    for b in batches:
        fresh = []
        for i, x in enumerate(b["node"].to_pylist()):
            if x not in seen:
                seen.add(x)
                fresh.append(i)
        if len(fresh) < b.num_rows:
            b = b.take(pa.array(fresh, pa.int64()))
        node = ints(b["node"])
        for c in chunks(b["text"], lower=True):
            sets, sizes = shingle_sets(c)
            offsets = np.zeros(c.texts + 1, np.int32)
            np.cumsum(sizes * 8, out=offsets[1:])
            yield batch(node=node[c.first : c.first + c.texts], shingles=pa.Array.from_buffers(pa.binary(), c.texts, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(sets.tobytes())]))


def _prune(percent: int):
    floor = floor_for(percent, HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pick = estimates(_matrix(b["sig_a"]), _matrix(b["sig_b"])) >= floor
                a, z = ints(b["a"])[pick], ints(b["b"])[pick]
                yield batch(a=a, b=z, ca=a, cb=z)  # no node has a component yet but itself

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed signatures as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(len(column), -1)


def _confirm(percent: int):
    """Links between the components of pairs whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = []
            for x, y in zip(b["set_a"], b["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    links.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                links.append(100 * common >= percent * (len(x) + len(y) - common))
            pick = np.array(links, bool)
            yield batch(a=ints(b["ca"])[pick], b=ints(b["cb"])[pick])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of many minima."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            own = [np.frombuffer(x.as_buffer(), U) for x in part["shingles"]]
            there = np.array([len(x) > 0 for x in own], bool)
            starts = np.cumsum([0, *[len(x) for x in own]])[:-1][there]
            sign = signatures(minima(np.concatenate(own), starts, FINE)) if there.any() else np.zeros((0, FINE * BITS // 64), U)
            yield batch(node=ints(part["node"])[there], signature=_binary(sign, there[there]))


def _meet(floor: float, bands_of: int, best: int = 0):
    """Pairs of a block whose components differ and whose estimate reaches floor; with best, so many partners of each.

    A pair that shares several buckets is looked at in the first of them only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block", 8192):
            block, node, comp, part, cross = (ints(t[c]) for c in ("block", "node", "component", "part", "cross"))
            sign = _matrix(t["signature"].combine_chunks())
            bucket, bands = ints(t["bucket"]), ints(t["bands"].combine_chunks().flatten()).reshape(-1, bands_of)
            out = []
            for s, m in zip(*runs(block), strict=True):
                for i in range(s, s + m):
                    rest = np.arange(s if best else i + 1, s + m)
                    rest = rest[(comp[rest] != comp[i]) & (node[rest] != node[i]) & ((cross[rest] == 0) | (part[rest] != part[i]))]
                    if len(rest):
                        common = np.argmax(bands[rest] == bands[i], axis=1)
                        rest = rest[bands[i][common] == bucket[i]]
                    if not len(rest):
                        continue
                    alike = estimates(sign[i], sign[rest])
                    if best and len(rest) > best:
                        top = np.argpartition(-alike, best - 1)[:best]
                        rest, alike = rest[top], alike[top]
                    rest = rest[alike >= floor]
                    if len(rest):
                        out.append(np.stack([np.full(len(rest), i), rest]))
            x, y = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            own = np.unique(np.stack([node[x], node[y], comp[x], comp[y]]), axis=1)
            yield batch(a=own[0], b=own[1], ca=own[2], cb=own[3])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Component of near copies of every document; see ``linked``.

    Returns ``id_col``, ``n_shingles``, ``component_id`` (the id of the row that leads the component; null where that has
    none) and ``kept`` (whether the row, or one equal to it in id and text, leads).
    """
    out = linked(docs, id_col, text_col, percent)
    return out.select(from_key("did").alias(id_col), "n_shingles", from_key("lead_did").alias("component_id"), "kept")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Every row as (did, tie, n_shingles, lead_did, kept): id, hash of its text, id of the row that leads its component.

    Words are lower-cased (A-Z); documents are linked where ``100 * intersection >= percent * union`` of their sets of
    five-word shingles. Returns one row for each row of docs. The row with the least id leads a component, among rows
    of that id the one whose text has the least hash.

    A text of fewer than five words has the whole sequence as its only shingle; null and empty texts have none and are
    linked with nothing. A null id (``NO_ID``) counts as the smallest. Rows that repeat an id and a text are returned as
    often; several texts of one id are documents of their own and may lead components of their own. Other columns are not
    looked at; an empty table gives an empty result. Below 11 percent the bands cannot find all pairs: a ``ValueError``.
    """
    n_bands, n_rows = bands_for(percent)
    text = text_of(text_col)
    texts = docs.select(id_key(id_col).alias("did"), F.xxhash64(text).alias("tie"), text.alias("text"))
    base = cut(texts.mapInArrow(_describe(n_bands, n_rows), "did long, tie long, n_shingles long, print1 long, print2 long, bands array<long>, signature binary").withColumn("row", F.monotonically_increasing_id()))
    # a node is the number of the row that leads a class
    lead = F.min(F.struct("did", "tie", "row")).alias("lead")
    classes = cut(base.where("n_shingles > 0").groupBy("print1", "print2").agg(lead).select("print1", "print2", "lead.did", "lead.tie", F.col("lead.row").alias("node")))
    buckets = base.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").drop("last")
    members = cut(buckets.join(shared, "bucket"))
    met = cut(classes.join(members.select("node").distinct(), "node", "left_semi").select("did", "tie", "node"))
    reps = cut(base.join(met.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "bands", "signature"))
    sets = cut(texts.join(met.hint("shuffle_hash"), ["did", "tie"]).select("node", "text").mapInArrow(_sets, "node long, shingles binary"))
    pairs_of = "a long, b long, ca long, cb long"

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        return cut(full.select("ca", "cb", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"))

    star = members.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    sig = lambda side: reps.select(F.col("node").alias(side), F.col("signature").alias(f"sig_{side}"))
    first = confirmed(star.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent), pairs_of))

    def apart(labels: DataFrame, fine: bool) -> DataFrame:
        """Members of buckets that hold several components, dealt into blocks that bring every two of a bucket together."""
        rest = members.where("node != head").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
        rest = cut(rest.join(split.select("bucket", parts.alias("parts")), "bucket").select("bucket", "node", "component", "parts"))
        dealt = (
            rest.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .withColumn("block", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
            .withColumn("cross", (F.col("part") != F.col("other")).cast("long"))
        )
        known = reps.select("node", "signature", "bands")
        if fine:
            there = rest.select("node").distinct()
            known = sets.join(there, "node", "left_semi").mapInArrow(_fine, "node long, signature binary").join(reps.select("node", "bands"), "node")
        return dealt.join(known, "node").select("block", "bucket", "node", "component", "part", "cross", "signature", "bands").repartition("block").sortWithinPartitions("block")

    def meet(labels: DataFrame, fine: bool) -> DataFrame:
        run = _meet(floor_for(percent, FINE), n_bands) if fine else _meet(floor_for(percent, HASHES), n_bands, BEST)
        return confirmed(apart(labels, fine).mapInArrow(run, pairs_of).dropDuplicates(["a", "b"]))

    def joined_by(labels: DataFrame, edges: DataFrame) -> DataFrame:
        """labels after links between components (or nodes that have none yet)."""
        to = components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
        return cut(labels.join(to, "component", "full").select(F.coalesce("node", "component").alias("node"), F.coalesce("to", "component").alias("component")))

    # links of the later rounds join components of the rounds before, so their graphs are small
    ones = cut(components(first))
    twos = joined_by(ones, meet(ones, fine=False))
    joined = joined_by(twos, meet(twos, fine=True))
    grouped = classes.join(joined, "node")
    heads = grouped.groupBy("component").agg(F.min(F.struct("did", "tie")).alias("lead"))
    led = grouped.join(heads, "component").select("node", "lead")
    named = classes.join(led, "node", "left").select("print1", "print2", F.coalesce("lead", F.struct("did", "tie")).alias("lead"))
    out = base.select("did", "tie", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print1")).alias("print1"), F.when(F.col("n_shingles") > 0, F.col("print2")).alias("print2")).join(named, ["print1", "print2"], "left")
    own = F.struct("did", "tie")
    return out.withColumn("lead", F.coalesce("lead", own)).select("did", "tie", "n_shingles", F.col("lead.did").alias("lead_did"), (F.col("lead") == own).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents; see ``near_duplicates``."""
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda s: array_to_string(ws[s:s + 4], ' '))) END AS gs FROM w),
s AS MATERIALIZED (SELECT doc_id, unnest(gs) AS x FROM g),
z AS MATERIALIZED (SELECT doc_id, len(gs) AS n FROM g),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS r FROM z UNION SELECT b.b, r.r FROM r JOIN b ON b.a = r.doc_id),
m AS (SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id)
SELECT z.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, z.doc_id = component_id AS kept FROM z JOIN m USING (doc_id)
"""
