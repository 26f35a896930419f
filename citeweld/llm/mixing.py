"""Mixing sources to target weights by blocks.

The words of each source, its documents in the order of their ids, are packed into blocks of 64 words. A source's target
number of words gives its number of draws. For each output shard of 4,096 slots the counts of the sources are a multinomial
draw with a seed of the shard's own. Draws of their own would miss the targets of small sources and the limit on repeats, so
the sums are then reconciled: in the order of shards, slots that a source has no draws left for go to the sources that have.
A source's k-th slot is place ``k mod blocks`` of pass ``k div blocks``; a pseudorandom permutation of the block numbers, with
a seed for each source and pass, turns it into a block, so no block is drawn twice more often than another. The last draw
takes only the words that are left of the target. Slots and blocks are then joined by source and block number.

Everything is computed from ids, sizes and the seed, so reruns agree. Texts are not moved to choose the mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spark import cut, in_order
from ._arrow import batch, ints
from ._spark import from_key, id_key, n_words, read, text_of
from ._words import U, ranges
from ._words import mix as spread_bits
from .feistel import permute

BLOCK = 64  # words of a block
SHARD = 4096  # slots of an output shard
WEIGHTS = (1.0, 2.0, 3.0)  # of the sources in order, repeating
MOST = 3  # times a source's size that its target may be
SEED = 10
GROUP = 1 << 16  # sources that a multinomial draw deals with at once
SPREAD = 1 << 17  # slots that a task unfolds to, about


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, target) from rows of (source, size).

    Sources are numbered by code point, null last; targets share out the sum of all sizes by weight, none above ``most``
    times its source's size. Each round finds the share of the sources that are not at their limit by one sum over the
    sources and fixes those that reach it, until none does.
    """
    sources = in_order(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()), ["_null", "source"], unique=True)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row_no") % len(weights) + 1).cast("int"))
    table = cut(sources.select("source", F.col("row_no").alias("source_no"), "source_size", weight.alias("weight")))
    limit = F.col("source_size") * F.lit(float(most))
    share, fixed = None, F.lit(False)
    while True:
        total = table.agg(F.sum("source_size"), F.sum(F.when(fixed, limit)), F.sum(F.when(~fixed, F.col("weight"))), F.sum(fixed.cast("long"))).first()
        if not total[2]:
            break
        share = ((total[0] or 0) - (total[1] or 0.0)) / total[2]
        over = fixed | (F.col("weight") * F.lit(share) > limit)
        if table.agg(F.sum(over.cast("long"))).first()[0] == total[3]:
            break
        fixed = over
    target = limit if share is None else F.when(fixed, limit).otherwise(F.col("weight") * F.lit(share))
    return table.select("source", "source_no", "source_size", target.cast("double").alias("target"))


def seeds(seed: int, *numbers: np.ndarray) -> np.ndarray:
    """A seed for each row of numbers."""
    out = np.full(len(numbers[0]), seed, U)
    for x in numbers:
        out = spread_bits(out * U(0x9E3779B97F4A7C15) + x.astype(U) + U(1))
    return out


def _plan(seed: int, size_of_block: int):
    """How often each source draws, and how many words its last draw takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            no, size, wanted = (ints(b[c]) for c in ("source_no", "source_size", "wanted"))
            blocks = -(-size // size_of_block)
            short = size - size_of_block * (blocks - 1)  # words of the last block
            epoch, rest = wanted // size, wanted % size
            # of the pass that is not whole: where its short block comes, and how many blocks hold the rest
            at = permute(blocks - 1, blocks, seeds(seed, no, epoch), back=True)
            draws = np.where(rest <= size_of_block * at, -(-rest // size_of_block), 1 + -(-np.maximum(rest - short, 0) // size_of_block))
            before = np.where(draws - 1 <= at, size_of_block * (draws - 1), size_of_block * (draws - 2) + short)
            last = np.where(rest > 0, rest - before, size_of_block)
            yield batch(source_no=no, blocks=blocks, draws=epoch * blocks + np.where(rest > 0, draws, 0), last=last)

    return run


def _rng(seed: int, *numbers: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, *numbers]))


def _share_out(seed: int, shard: int, total: int, weights: np.ndarray):
    """Multinomial counts of each group of sources for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in ints(b["id"]).tolist():
                n = _rng(seed, s).multinomial(min(shard, total - s * shard), weights / weights.sum())
                kept = np.flatnonzero(n)
                yield batch(shard=np.full(len(kept), s), group=kept, n=n[kept])

    return run


def _share_group(seed: int):
    """Multinomial counts of the sources of a group for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, group, n = (ints(b[c]) for c in ("shard", "group", "n"))
            sources, draws = b["sources"], b["draws"]
            for i in range(b.num_rows):
                weight = draws[i].values.to_numpy(zero_copy_only=False).astype(float)
                own = _rng(seed, int(shard[i]), int(group[i])).multinomial(n[i], weight / weight.sum())
                kept = np.flatnonzero(own)
                yield batch(shard=np.full(len(kept), shard[i]), source_no=sources[i].values.to_numpy(zero_copy_only=False)[kept], n=own[kept])

    return run


def _unfold(seed: int, size_of_block: int):
    """A row for each slot: its block, its pass, its place in the shard and how many words of the block it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {x: ints(b[x]) for x in b.schema.names}
            end = np.cumsum(c["n"])
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SPREAD, "right")))
                own = {x: v[at:stop] for x, v in c.items()}
                at = stop
                row = np.repeat(np.arange(len(own["n"])), own["n"])
                step = ranges(np.zeros(len(own["n"]), np.int64), own["n"])
                no, shard, blocks, slot = own["source_no"][row], own["shard"][row], own["blocks"][row], own["first"][row] + step
                epoch = slot // blocks
                block = permute(slot % blocks, blocks, seeds(seed, no, epoch))
                place = permute(own["ahead"][row] + step, own["slots"][row], seeds(seed + 1, shard))
                words = np.where(slot == own["draws"][row] - 1, own["last"][row], size_of_block)
                yield batch(source_no=no, block=block, epoch=epoch, shard=shard, place=place, most=words)

    return run


def draw(sources: DataFrame, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD) -> DataFrame:
    """(source_no, block, epoch, shard, place, most): a row for each slot of the mix; ``most`` words of its block count."""
    spark = sources.sparkSession
    wanted = sources.where("source_size > 0").select("source_no", "source_size", F.round("target").cast("long").alias("wanted")).where("wanted > 0")
    plan = cut(wanted.mapInArrow(_plan(seed, block), "source_no long, blocks long, draws long, last long"))
    groups = plan.groupBy(F.expr(f"source_no div {GROUP}L").alias("group")).agg(F.sum("draws").alias("all"), F.array_sort(F.collect_list(F.struct("source_no", "draws"))).alias("own"))
    sums = groups.select("group", "all").toArrow()  # a number for each 65,536 sources
    total = sum(sums["all"].to_pylist())
    if not total:
        return plan.where("false").select("source_no", *[F.lit(0).cast("long").alias(c) for c in ("block", "epoch", "shard", "place", "most")])
    weights = np.zeros(max(sums["group"].to_pylist()) + 1)
    weights[sums["group"].to_numpy()] = sums["all"].to_numpy()
    shards = spark.range(0, -(-total // shard_slots), 1, max(1, total // (shard_slots * 256)))
    dealt = shards.mapInArrow(_share_out(seed, shard_slots, total, weights), "shard long, group long, n long")
    lists = groups.select("group", F.col("own.source_no").alias("sources"), F.col("own.draws").alias("draws"))
    # one group has 65,536 sources of two numbers at most; more of them are joined
    counts = dealt.join(F.broadcast(lists) if len(weights) == 1 else lists, "group").mapInArrow(_share_group(seed), "shard long, source_no long, n long")
    # in the order of shards, a source takes what it drew until it has all its draws
    taken = cut(in_order(counts, ["source_no", "shard"], group="source_no", size="n", unique=True).join(plan.select("source_no", "draws"), "source_no").withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("draws") - F.col("before")))))
    spare = in_order(taken.groupBy("shard").agg(F.sum(F.col("n") - F.col("own")).alias("n")).where("n > 0"), ["shard"], size="n", unique=True)
    have = taken.groupBy("source_no").agg(F.sum("own").alias("own"))
    lacking = in_order(plan.join(have, "source_no", "left").select("source_no", F.coalesce("own", F.lit(0)).alias("own"), (F.col("draws") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0"), ["source_no"], size="n", unique=True)
    units = lambda d, *columns: d.select(*columns, "before", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("unit"))
    more = units(spare, "shard").drop("before").join(units(lacking, "source_no", "own"), "unit").select("shard", "source_no", (F.col("own") + F.col("unit") - F.col("before")).alias("first"), F.lit(1).cast("long").alias("n"))
    parts = taken.where("own > 0").select("shard", "source_no", F.col("before").alias("first"), F.col("own").alias("n")).unionByName(more)
    inside = Window.partitionBy("shard")
    ahead = F.coalesce(F.sum("n").over(inside.orderBy("source_no", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = parts.select("*", ahead.alias("ahead"), F.sum("n").over(inside).alias("slots")).join(plan, "source_no").repartition(max(1, total // SPREAD), "shard")
    return laid.mapInArrow(_unfold(seed, block), "source_no long, block long, epoch long, shard long, place long, most long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs as three tables.

    ``documents``: doc (a number within the source), id, size, source columns and target. ``pieces``: for each drawn
    slot (shard, place) the pieces of documents in its block: source_no, doc, epoch, from_word, words. ``sources``: the
    targets, see ``source_targets``. The words taken of a source are its target, rounded.

    Null texts and texts without words have size 0 and are never drawn; they belong to their source all the same. A null
    source is a source of its own, the last one. Rows that repeat an id each hold their own words. Only the named columns
    are looked at; an empty table gives empty results.
    """
    sized = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), id_key(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("tie"), n_words(text_of(text_col)).alias("size"))
    numbered = cut(in_order(sized, ["source", "did", "tie"], group="source", size="size"))
    sources = cut(source_targets(numbered.select("source", "size")))
    drawn = draw(sources, block, seed, shard_slots)
    named = numbered.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("source", "source_no", "did", "tie", "size", F.col("row_no").alias("doc"), "before", "source_size", "target")
    laid = named.where("size > 0").select("source_no", "doc", "size", "before", F.explode(F.sequence(F.expr(f"before div {block}L"), F.expr(f"(before + size - 1) div {block}L"))).alias("block"))
    start, end = F.greatest(F.col("block") * block, F.col("before")), F.least((F.col("block") + 1) * block, F.col("before") + F.col("size"))
    parts = laid.select("source_no", "block", "doc", (start - F.col("before")).alias("from_word"), (start - F.col("block") * block).alias("at"), (end - start).alias("own"))
    # neither side has a bound: slots look as small as the counts that they unfold from, so the join is stated
    pieces = drawn.hint("merge").join(parts, ["source_no", "block"]).withColumn("words", F.least("own", F.col("most") - F.col("at"))).where("words > 0")
    return named, pieces.select("shard", "place", "source_no", "block", "epoch", "doc", "from_word", "words"), sources


def op10_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see ``mix``."""
    documents, pieces, _ = mix(read(spark, sf_dir, "documents"))
    taken = pieces.groupBy("source_no", "doc").agg(F.sum("words").alias("taken"))
    out = documents.join(taken, ["source_no", "doc"], "left")
    return out.select(from_key("did").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _lay_out(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, texts = [], []
            for i, (text, found) in enumerate(zip(b["text"].to_pylist(), b["found"].to_pylist(), strict=True)):
                words = None
                by_pass: dict[int, list[tuple[int, int]]] = {}
                for f in found:
                    by_pass.setdefault(f["epoch"], []).append((f["from_word"], f["words"]))
                for _, parts in sorted(by_pass.items()):
                    parts.sort()
                    if sum(n for _, n in parts) == b["size"][i].as_py():
                        texts.append(text)
                    else:
                        words = words or text.encode().split()
                        joined, end = [], None
                        for at, n in parts:
                            if end is not None:
                                joined.append(b" " if at == end else b"\n")
                            joined.append(b" ".join(words[at : at + n]))
                            end = at + n
                        texts.append(b"".join(joined).decode())
                    row.append(i)
            part = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[part[x] for x in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def _numbered_twins(texts: DataFrame, alike: list[str]) -> DataFrame:
    """texts with ``twin``: 0, 1, ... among the rows that are equal in the columns alike, however many those are.

    Rows are numbered within the partition that they are read from, and shifted by the counts of the partitions ahead.
    """
    kept = cut(texts.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    ahead = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = kept.groupBy(*alike, "part").agg(F.count(F.lit(1)).alias("n")).select(*alike, "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    at = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("place")) - 1
    return kept.withColumn("at", at).join(shift, [*alike, "part"]).withColumn("twin", (F.col("at") + F.col("shift")).cast("long")).drop("part", "place", "at", "shift")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), **options: int) -> DataFrame:
    """The mix as documents: of each document a row for every pass that takes words of it, with those words as its text.

    A pass that takes all of a document leaves its text as it is; gaps become line ends. Rows that the mix does not take
    are not returned. Rows alike in source, id and text are documents of their own: the n-th of them takes the n-th plan.
    Nulls, empty texts and tables are taken as ``mix`` does.
    """
    documents, pieces, _ = mix(docs, id_col, text_col, source_col, **options)
    found = pieces.groupBy("source_no", "doc").agg(F.collect_list(F.struct("epoch", "from_word", "words")).alias("found"))
    names = [f"_c{i}" for i in range(len(carry))]
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # equal where sources are, null or not
    alike = ["did", "tie", "key"]
    # equal rows follow each other in a source, so the first one's number tells which of them a row is
    own = cut(documents.select("source_no", "doc", "source", "did", "tie", "size", key.alias("key")))
    firsts = own.groupBy(*alike).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    plans = own.join(found, ["source_no", "doc"]).join(firsts, alike).select(*alike, "size", "found", (F.col("doc") - F.col("first")).alias("twin"))
    texts = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), id_key(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)]).withColumn("key", key)
    if firsts.where("n > 1").isEmpty():
        joined = texts.join(plans.drop("twin"), alike)
    else:
        joined = _numbered_twins(texts, alike).join(plans, [*alike, "twin"])
    flat = joined.select("did", "source", "text", "size", *names, "found")
    kinds = "".join(f", {n} {docs.select(f'`{c}`').schema[0].dataType.simpleString()}" for c, n in zip(carry, names, strict=True))
    out = flat.mapInArrow(_lay_out(["did", "source", *names]), f"did long, source string{kinds}, text string")
    return out.select(from_key("did").alias(id_col), F.col("text").alias(text_col), F.col("source").alias(source_col), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)])
