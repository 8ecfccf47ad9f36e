"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New documents are reduced to one row for each digest (partial sums first, so a text that a third of
all rows share is one row a task), anti-joined with the index by sort-merge, and what is new is appended under the name
of its batch. A batch that is run again finds its own digests and gives the same result. Only DataFrame operations; a text is
read and never shuffled to find duplicates; to drop them, only texts whose doc_id has a row that goes are moved
(all texts, if those ids are more than a broadcast may hold).

Cases: a null text counts as empty; of equal texts the largest doc_id stays; a row with a null doc_id stays
only if no row of its text has an id, and rows that repeat one doc_id and text are one document, of which a single
row stays. A text that an earlier batch of the index holds is dropped; its keep_id is that batch's, and its group_size counts the
rows of that batch and of this one. An empty table gives an empty result; columns besides doc_id and text pass through untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, enrich, materialize, split_by_ids

#: A digest with a thousandth of all rows is hot; there are at most so many, which bounds what is broadcast.
HOT_SHARE = 1000


def digest():
    return F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """A table (text_sha256, keep_id, group_size, batch), bucketed and sorted by text_sha256, that grows by appends."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.wanted = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    @property
    def buckets(self) -> int:
        """As the catalog has it, whatever the session that opens the index; as wanted for a new one."""
        if not self.exists():
            return self.wanted
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, buckets: int, mode: str) -> None:
        # dealt by bucket, so that each bucket is one sorted file of this write
        rows.repartition(buckets, "text_sha256").write.mode(mode).bucketBy(buckets, "text_sha256").sortBy("text_sha256").format("parquet").saveAsTable(name)

    def add(self, digests: DataFrame, batch: str = "") -> None:
        """Append those digests of (doc_id, text_sha256) that the index lacks."""
        groups = digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("batch", F.lit(batch))
        if self.exists():
            groups = groups.join(self.read().hint("merge"), "text_sha256", "left_anti")
        self._write(groups, self.name, self.buckets, "append")

    def find(self, digests: DataFrame) -> DataFrame:
        """digests with keep_id, group_size and batch. Hot digests, of bounded number, are joined by broadcast, the rest by merge."""
        total = self.read().agg(F.sum("group_size")).first()[0] or 0
        return enrich(digests, self.read(), ["text_sha256"], F.col("group_size") * HOT_SHARE >= F.lit(total))

    def compact(self) -> None:
        """One sorted file a bucket again, after many appends."""
        other = f"{self.name}_{uuid.uuid4().hex[:8]}"
        self._write(self.read(), other, self.buckets, "overwrite")
        self.drop()
        self.spark.sql(f"ALTER TABLE {other} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def decide(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row. Name a batch to run it again after a loss."""
    spark = docs.sparkSession
    digests = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("text_sha256")), "digests")
    own = index or DigestIndex(spark)
    batch = batch or uuid.uuid4().hex
    old = own.exists()
    own.add(digests, batch)
    found = own.find(digests)
    mine = F.col("batch") == batch
    if old:  # the rows of this batch whose text an earlier one has
        more = enrich(digests, own.read().filter(~mine).select("text_sha256", "group_size"), ["text_sha256"], F.lit(False), "inner").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("__more"))
        found = found.join(more.hint("merge"), "text_sha256", "left").withColumn("group_size", F.col("group_size") + F.coalesce("__more", F.lit(0)))
    again = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id"))
    kept = mine & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)
    found = found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    if index is None:  # nothing of an index that nobody named stays behind
        found = materialize(found, "decided")
        own.drop()
    return found


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with their own columns."""
    decided = materialize(decide(docs, index, batch), "decided")
    gone = materialize(decided.filter("not kept").select("doc_id").distinct(), "gone")
    sure, others = split_by_ids(docs, "doc_id", gone)
    stay = decided.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    named = others.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__digest", digest())
    joined = named.join(stay.hint("merge"), named["__id"].eqNullSafe(stay["__id"]) & (named["__digest"] == stay["__digest"]), "left_semi")
    again = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy("__id"))
    return sure.unionByName(joined.withColumn("__again", again).filter("__again = 1").select(*docs.columns))
