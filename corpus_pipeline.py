"""Documents made ready for training: five stages, each over all that the one before kept.

``run`` writes each stage's result as Parquet in the shared folder and reads it for the next one. Every stage but the
last returns the columns of ``documents``; the last returns the pieces of the packed sequences. Stages take nulls, empty
texts, repeated rows and ids as their operators do; see there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweld.llm import minhash, mixing, packing, quality, substring
from citeweld.llm._spark import id_key, text_of
from citeweld.spark import cut, remove, shared_folder, tidied

NEAR_PERCENT = 80  # of the union of two documents' shingles that is common where one of them goes
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score under one half go. It learns from all labels of documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.train(docs, labels)
    return quality.score(docs, machine, carry=("text", "lang", "source", "n_chars")).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates: of each component the document with the smallest id stays; rows that repeat it go too.

    Several texts under one id, or under none, are documents of their own: a text stays where it leads its component, whatever
    becomes of the others of its id. Of rows equal in id and text one stays.
    """
    wanted = cut(minhash.linked(docs, percent=NEAR_PERCENT).where("kept").select(F.col("did").alias("_id"), F.col("tie").alias("_tie")).distinct())
    mine = docs.withColumn("_id", id_key("doc_id")).withColumn("_tie", F.xxhash64(text_of("text"))).join(wanted.hint("shuffle_hash"), ["_id", "_tie"], "left_semi")
    return mine.dropDuplicates(["_id", "_tie"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages of 20 words that start earlier go; a document of which nothing is left goes with them."""
    out = substring.remove_repeats(docs, carry=("lang", "source"))
    return _columns(out.where("n_words = 0 OR n_removed < n_words").select("doc_id", F.col("kept_layout").alias("text"), "lang", "source"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources in the shares of their targets; a document comes once for each pass that takes words of it."""
    return _columns(mixing.mixed_documents(docs, carry=("lang",)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of documents in sequences of 1,024 tokens, filled by lexical neighbours."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]

#: A fitted classifier and a mix by pseudorandom permutations are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        with tidied():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
