"""Exact dedup against a persistent index of text digests.

The index is a table of one row per distinct text, bucketed and sorted by the text's SHA-256. A batch of
documents is reduced to its distinct digests first (partial aggregates, so a text that fills a third of the
batch travels as one row per task), these meet the index in a sort-merge anti-join in which the index side
is read bucket by bucket without a shuffle, and what is new is appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.llm.common import saved, shared_dir, tasks, text_or_empty, unused

INDEX_LAYOUT = "digest BINARY, keep_id BIGINT"


class DigestIndex:
    """Index at `path`, opened as table `name` of the session's catalog; `buckets` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_LAYOUT}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, batch: DataFrame) -> None:
        """Append the digests of `batch` (digest, keep_id; distinct) that the index lacks."""
        dealt = batch.repartition(self.buckets, "digest")
        fresh = dealt.hint("merge").join(self.table(), "digest", "left_anti")
        # An own copy: a table can't be read and appended to by one job.
        saved(fresh.select("digest", "keep_id")).repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of whole texts; null counts as empty. Other columns are left alone."""
    return docs.select("doc_id", F.unhex(F.sha2(F.encode(text_or_empty(), "utf-8"), 256)).alias("digest"))


def deduplicated(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; the index gains the new texts.

    Of equal texts in the batch the row with the largest doc_id stays, unless an earlier batch brought the
    text: then none stays and keep_id is the earlier row's. group_size counts the batch's rows of that text.
    Rows that repeat id and text are one document and share its fate. A row without id loses against any row
    with one; a text whose rows all lack ids keeps them. An empty table gives no rows.
    """
    rows = digests(docs)
    batch = saved(rows.groupBy("digest").agg(F.max("doc_id").alias("batch_keep"), F.count(F.lit(1)).alias("group_size")))
    index.append_new(batch.withColumnRenamed("batch_keep", "keep_id"))
    classes = saved(
        batch.repartition(index.buckets, "digest").hint("merge").join(index.table(), "digest")
        .select("digest", "keep_id", "group_size")
    )
    return rows.join(classes, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    path = shared_dir(spark)
    return DigestIndex(spark, path, f"digest_index_{path.rsplit('/', 1)[-1]}", tasks(spark))


def distinct_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of `docs` that stay, once each and with all their columns.

    Null and empty texts are equal. Of rows that repeat id and text, and of a text's rows without any id, one stays;
    a text that the index had before keeps none. An empty table gives no rows.
    """
    key, nth = unused(docs, "_key"), unused(docs, "_nth")
    stay = saved(deduplicated(docs, index).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct())
    keyed = docs.withColumn(key, F.sha2(F.encode(text_or_empty(), "utf-8"), 256))
    met = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed[key] == stay["_sha"]), "left_semi")
    first = Window.partitionBy(key, "doc_id").orderBy(key)
    return met.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)
