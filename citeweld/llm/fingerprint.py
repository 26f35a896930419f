"""Document fingerprints by one-permutation MinHash, in SQL functions only.

A text's five-word shingles are hashed once each. The top bits of a hash choose one of 128 bins, the bin keeps its least
hash. An empty bin takes the value of the first filled bin in a random order of all bins that belongs to it (optimal
densification: every filled bin is as likely), so two texts fill it alike where they agree. The low four bits of the
128 values, each hashed once more with its bin so that a value in several bins is not compared several times alike, are
written as hexadecimal digits. The share of equal digits, corrected for digits that agree by chance,
estimates the similarity of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark import cut, in_order
from ._spark import SPACE, from_key, id_key, read, text_of, trimmed

BINS = 128
SHINGLE = 5
PROBES = 12  # bins that are tried one by one before the filled ones are ranked


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column, a string of 128 hexadecimal digits.

    A null or empty text is the set of one empty shingle, a text of fewer than five words that of its whole sequence.
    """
    t = lambda x: F.col(f"_{x}_{out}")
    name = lambda x: f"_{x}_{out}"
    df = df.withColumn(name("w"), F.split(trimmed(F.coalesce(F.col(text_col), F.lit(""))), f"{SPACE}+"))
    many = F.transform(F.sequence(F.lit(0), F.size(t("w")) - SHINGLE), lambda i: F.xxhash64(*[F.get(t("w"), i + k) for k in range(SHINGLE)]))
    df = df.withColumn(name("h"), F.sort_array(F.when(F.size(t("w")) >= SHINGLE, many).otherwise(F.array(F.xxhash64(F.array_join(t("w"), " "))))))
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BINS.bit_length() + 1).cast("int")
    # sorted hashes come bin by bin: the first of each bin is its least
    df = df.withColumn(name("m"), F.filter(t("h"), lambda h, i: (i == 0) | (bin_of(F.get(t("h"), i - 1)) != bin_of(h))))
    df = df.withColumn(name("b"), F.transform(t("m"), bin_of))
    df = df.withColumn(name("s"), F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(t("m"), (F.array_position(t("b"), j) - 1).cast("int"))))
    # bin j tries bins that a hash of (j, try) names; after PROBES of them, the filled bins in the order of a hash of (j, bin)
    tries = lambda j: [F.get(t("s"), F.pmod(F.xxhash64(j, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
    last = lambda j: F.array_min(F.transform(t("m"), lambda v: F.struct(F.xxhash64(j, F.lit("rank"), bin_of(v)).alias("r"), v.alias("v"))))["v"]
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.lower(F.hex(F.xxhash64(F.coalesce(F.get(t("s"), j), *tries(j), last(j)), j).bitwiseAND(F.lit(15).cast("long")))))
    return df.withColumn(out, F.array_join(dense, "")).drop(*[name(x) for x in "whmbs"])


def likeness(a: Column, b: Column) -> Column:
    """Similarity (0 to 1) of two fingerprints: digits agree by chance once in 16."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (same - F.lit(1 / 16)) / F.lit(1 - 1 / 16))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter replaced by the start of the next document.

    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``. The next document is that of the next larger id, after the last one the first; a null id comes first.
    Rows with one id and one text are one document and all get its result; several texts under one id follow each other
    by ``xxhash64``. Null texts are empty. Other columns are not looked at; an empty table gives an empty result.

    Texts are shuffled once, by document; each sends the start that the document before it needs.
    """
    text = text_of(text_col)
    texts = docs.select(id_key(id_col).alias("did"), F.xxhash64(text).alias("tie"), text.alias("text"))
    ids = texts.select("did", "tie", F.char_length("text").cast("long").alias("n_chars")).distinct()
    order = cut(in_order(ids, ["did", "tie"]).select("did", "tie", "n_chars", "row_no"))
    n = order.count()
    before = order.select(F.col("did").alias("to_did"), F.col("tie").alias("to_tie"), F.expr("n_chars div 4").alias("give"), ((F.col("row_no") + 1) % F.lit(max(n, 1))).alias("row_no"))
    gifts = order.join(before, "row_no").select("did", "tie", "to_did", "to_tie", "give")
    starts = texts.join(gifts.hint("shuffle_hash"), ["did", "tie"]).select(F.col("to_did").alias("did"), F.col("to_tie").alias("tie"), F.substring(F.col("text"), F.lit(1), F.col("give").cast("int")).alias("start"))
    starts = starts.groupBy("did", "tie").agg(F.max("start").alias("start"))
    both = texts.join(starts.hint("shuffle_hash"), ["did", "tie"])
    chars = F.char_length("text")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (chars - F.floor(chars / 4)).cast("int")), F.col("start")))
    printed = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    done = cut(printed.select("did", "tie", chars.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"))
    after = gifts.select(F.col("to_did").alias("did"), F.col("to_tie").alias("tie"), F.col("did").alias("n_did"), F.col("tie").alias("n_tie"))
    nexts = done.select(F.col("did").alias("n_did"), F.col("tie").alias("n_tie"), F.col("fingerprint").alias("_next")).distinct()
    out = done.join(after.join(nexts, ["n_did", "n_tie"]).select("did", "tie", "_next"), ["did", "tie"])
    return out.select(from_key("did").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))


def op9_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see ``fingerprint_edits``."""
    return fingerprint_edits(read(spark, sf_dir, "documents"))
