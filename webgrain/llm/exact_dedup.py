"""Exact dedup against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest. A batch is reduced to one row per
digest, sort-merge anti-joined to the index and what is new is appended, so the index side
is never shuffled. Texts are equal when they are identical after lower-casing A-Z only.

A batch has a name. A job that died after it had appended is run again with the same name and rows:
what the batch itself has brought in counts as new to it, is not appended twice, and the verdicts
are those that the first run would have given. The number of buckets belongs to the table: it is set
when the table is made and read from it later.

Defined results: a null text counts as the empty text; all empty texts are one group; of
equal texts the row with the largest id stays (a null id is smallest; among rows that also
repeat the id exactly one stays); a text that an earlier batch brought in stays with that
batch's id and no row of the new batch is kept; an empty table gives an empty result;
a very long text is hashed whole; further columns of the input are not read.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm.scratch import cut, shuffle_partitions


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII alone take the byte-wise path of lower()."""
    full = F.coalesce(text, F.lit(""))
    plain = F.octet_length(full) == F.char_length(full)
    return F.when(plain, F.lower(full)).otherwise(F.translate(full, string.ascii_uppercase, string.ascii_lowercase))


class DigestIndex:
    """Digests seen so far, as the table `name` of the session's catalog.

    path: a folder that driver and executors share, for a table outside the session's warehouse. buckets: for a new table; by default
    as many as shuffle partitions, 64 at least, so that a table of many terabytes gets them by that setting.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        if spark.catalog.tableExists(name):
            self.buckets = int(spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
        else:
            self.buckets = buckets or max(64, shuffle_partitions(spark))
            self._append(spark.createDataFrame([], "digest binary, keep_id bigint, batch string"))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, batch: str | None = None) -> DataFrame:
        """Judge a batch and append its new digests.

        Returns one row per row of docs: id_col, keep_id, group_size (rows of the batch with
        that text), kept, text_sha256, row_id (row_col, unique row numbers, where it is given).
        """
        batch = batch or uuid.uuid4().hex
        rows = cut(docs.select(
            F.col(id_col).cast("bigint").alias("_id"),
            (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("_row"),
            F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest")), "digests")
        groups = cut(rows.groupBy("digest").agg(
            F.max(F.struct("_id", "_row")).alias("top"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        known = self.table().select("digest").hint("merge")  # with what an earlier run of this batch has appended
        new = groups.join(known, "digest", "left_anti")
        self._append(new.select("digest", F.col("top._id").alias("keep_id"), F.lit(batch).alias("batch")))
        judged = cut(groups.join(self.table().hint("merge"), "digest").select("digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("top._row")).alias("keep_row")), "digest-judged")
        return rows.join(judged, "digest").select(
            F.col("_id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("_row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), F.col("_row").alias("row_id"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text",
                buckets: int | None = None, row_col: str | None = None, batch: str | None = None) -> DataFrame:
    """Verdicts for docs; without an index, against a new empty one, which goes again."""
    own = index or DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}", buckets)
    verdicts = own.add(docs, id_col, text_col, row_col, batch)
    if index is None:
        own.drop()  # verdicts are read from written tables
    return verdicts
