"""New records as they arrive, against what was kept before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..config import MatchConfig
from ..operators.enrich import enriched
from ..plans.linkage import link
from ..sources import ris
from ..spark import cut, in_order, path_of


def absorb(batch: DataFrame, kept: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """The items of a batch that are no duplicates of kept items or of each other, completed from their duplicates."""
    shift = kept.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    old = kept.withColumn("is_old", F.lit(True)).withColumn("id", -F.abs("id")).withColumn("pos", F.col("pos") - F.lit(shift + 1)).withColumn("label", F.lit(None).cast("string"))
    pool = cut(old.unionByName(batch))
    return enriched(cut(link(pool, True, config))).where("NOT is_old AND kept AND (label IS NULL OR NOT startswith(label, '-'))").drop("kept")


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, config: MatchConfig | None = None) -> StreamingQuery:
    """Reads RIS files that are put into folder and appends new items to the Parquet table store.

    A batch writes a folder named by its number, so a batch that is repeated after a failure replaces what it wrote.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ris").load(folder)

    def each(df: DataFrame, number: int) -> None:
        paths = [r[0] for r in df.select("path").collect()]  # names of the batch's files
        if not paths:
            return
        items = None
        for k, p in enumerate(sorted(paths)):
            own = ris.read_items(df.sparkSession, p).withColumn("_file", F.lit(k)).withColumnRenamed("pos", "_p")
            items = own if items is None else items.unionByName(own)
        numbered = in_order(items, ["_file", "_p"]).withColumn("pos", F.col("row_no") + 1 + F.lit(number * (1 << 32)))
        items = numbered.select(*schema.ITEM.names)
        items = items.withColumn("id", F.col("pos"))
        earlier = [f"{store}/batch={n}" for n in range(number)]
        have = [p for p in earlier if _exists(df.sparkSession, p)]
        kept = df.sparkSession.read.parquet(*have).select(*items.columns) if have else items.limit(0)
        absorb(cut(items), cut(kept), config).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)
