"""Shards by a permutation of row numbers.

Documents are numbered in the order of their ids over the whole table; a Feistel permutation with cycle walking maps a
number to a place, and place mod shards and place div shards are its shard and slot. The shuffle can be repeated from
the seed, shards differ by one row at most, and where a row lies, or which row lies somewhere, can be computed without
looking it up. Built from DataFrame functions only; rows without their texts are dealt by range once to be numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark import in_order
from ._spark import read
from .feistel import PRIME, Permutation, constants

SHARDS = 24
SEED = 20


def assign_shards(rows: DataFrame, by: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with ``row_no``, ``shard`` (0 .. shards - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    Rows are numbered in the order of ``by``, nulls first; rows alike in ``by`` share out their numbers among them. The
    counts of shards differ by one at most; rows with equal contents may lie in different shards. Columns of rows that
    are called like one of the three are replaced, all others stay, whatever their names; an empty table gives an empty result.
    """
    added = ("row_no", "shard", "slot")
    wanted = [c for c in rows.columns if c.lower() not in added]
    plain = rows.select(F.struct("*").alias("all"), *[F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(by)])
    numbered = in_order(plain, [f"by{i}" for i in range(len(by))])
    place = Permutation(numbered.count(), seed).column(numbered.select("all", "row_no"), "row_no", "place")
    return place.select(*[F.col(f"all.`{c}`").alias(c) for c in wanted], "row_no", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}L").alias("slot"))


def locate(row_no: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number, of n."""
    slot, shard = divmod(Permutation(n, seed)(row_no), shards)
    return shard, slot


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies in a slot of a shard."""
    return Permutation(n, seed).inverse(slot * shards + shard)


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``; a null text counts as empty, a null id comes first.

    Equal texts form no unit here: ``rows`` deals every row by its number alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    steps, k = [], 0
    for walk in range(6):
        steps.append(f"q{k} AS (SELECT * REPLACE (CAST(p // b AS BIGINT) AS l, p % b AS r) FROM {'o' if walk == 0 else f'w{walk}'})")
        for i, (m, c, d) in enumerate(constants(SEED)):
            x = "r" if i % 2 == 0 else "l"
            t = f"(({x} * {m} + {c}) % {PRIME})"
            changed = f"(l + ({t} * {t} + {d}) % {PRIME}) % a AS l" if i % 2 == 0 else f"(r + ({t} * {t} + {d}) % {PRIME}) % b AS r"
            steps.append(f"q{k + 1} AS (SELECT * REPLACE ({changed}) FROM q{k})")
            k += 1
        again = "l * b + r" if walk == 0 else "CASE WHEN p < n THEN p ELSE l * b + r END"
        steps.append(f"w{walk + 1} AS (SELECT * REPLACE ({again} AS p) FROM q{k})")
        k += 1
    return (
        "WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, encode(coalesce(text, '')) AS raw FROM documents),\n"
        "t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS c FROM range(256) x(i))),\n"
        "h AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, size - 7), lambda i: CAST(('0x' || substr(hex(raw), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))), lambda v, y: xor(v >> 8, tab[CAST((xor(v, y) & 255) + 1 AS BIGINT)]))) AS text_crc32 FROM d, t),\n"
        "o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS p, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a, CAST(ceil(count(*) OVER () / ceil(sqrt(count(*) OVER ()))) AS BIGINT) AS b, CAST(0 AS BIGINT) AS l, CAST(0 AS BIGINT) AS r FROM h),\n"
        + ",\n".join(steps)
        + "\nSELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % 24 AS INTEGER) AS shard, CAST(p // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM w6"
    )


ORACLE = _oracle()
