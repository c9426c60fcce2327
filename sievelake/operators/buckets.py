"""A stored table in folders by key bucket, of which a change rewrites only those it touches.

``rows/version=v/bucket=b`` holds what version v wrote of bucket b, ``live/version=v`` names the version that
each bucket is read from. Rows come first and the live table last, so a failed change leaves the
table as it was, and repeating it overwrites what it left; older versions stay readable. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .mutate import upsert_full, upsert_partial

SALTS = 16
LIVE = "bucket int, live bigint"


@dataclass(frozen=True)
class BucketTable:
    """One version of a table, cut into ``buckets`` by a hash of ``key``."""

    spark: SparkSession
    path: str
    version: int
    key: str
    buckets: int
    columns: tuple

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def live(self) -> DataFrame:
        """(bucket, live): a row per bucket."""
        return self.spark.read.schema(LIVE).parquet(f"{self.path}/live/version={self.version}")

    def _stored(self, buckets: Sequence[int] | None = None) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/rows").where(F.col("version") <= self.version)
        live = self.live()
        if buckets is not None:
            found, live = (df.where(F.col("bucket").isin(list(buckets))) for df in (found, live))
        found = found.join(F.broadcast(live), "bucket").where(F.col("version") == F.col("live"))
        return found.select(*self.columns)

    def rows(self) -> DataFrame:
        return self._stored()

    def _write(self, rows: DataFrame, version: int) -> None:
        salt = F.pmod(F.hash(self.key, F.lit(SALTS)), F.lit(SALTS))  # a bucket may get very many changes
        rows = rows.select(*self.columns, self._bucket()).repartition("bucket", salt)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")

    def _replaced(self, touched: Sequence[int], change: Callable[[DataFrame], DataFrame]) -> "BucketTable":
        if not touched:
            return self
        version = self.version + 1
        self._write(change(self._stored(touched)), version)
        new = F.when(F.col("bucket").isin(list(touched)), F.lit(version)).otherwise(F.col("live"))
        live = self.live().select("bucket", new.cast("bigint").alias("live"))
        live.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/version={version}")
        return BucketTable(self.spark, self.path, version, self.key, self.buckets, self.columns)

    def _of(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys, at most as many as the table has."""
        return sorted(r["bucket"] for r in keys.select(self._bucket()).distinct().collect())

    def upsert(self, changes: DataFrame, sequence: str | None = None) -> "BucketTable":
        """As ``mutate.upsert_full``."""
        return self._replaced(self._of(changes), lambda rows: upsert_full(rows, changes, self.key, sequence))

    def upsert_partial(self, changes: DataFrame, columns: Sequence[str], sequence: str | None = None) -> "BucketTable":
        """As ``mutate.upsert_partial``."""
        return self._replaced(
            self._of(changes), lambda rows: upsert_partial(rows, changes, columns, self.key, sequence)
        )

    def delete(self, keys: DataFrame) -> "BucketTable":
        """Remove the rows with these keys; buckets that hold none of them are not written."""
        gone = keys.select(self.key).distinct()
        held = self._stored(self._of(gone)).select(self.key).join(gone, self.key, "left_semi")
        return self._replaced(self._of(held), lambda rows: rows.join(gone, self.key, "left_anti"))


def create(rows: DataFrame, path: str, key: str = "id", buckets: int = 256) -> BucketTable:
    """Write version 1 of a table at ``path``."""
    spark = rows.sparkSession
    table = BucketTable(spark, path.rstrip("/"), 1, key, buckets, tuple(rows.columns))
    about = spark.range(1).select(
        F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.array(*map(F.lit, rows.columns)).alias("columns")
    )
    about.coalesce(1).write.mode("overwrite").parquet(f"{table.path}/about")
    table._write(rows, 1)
    live = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(1).cast("bigint").alias("live"))
    live.coalesce(1).write.mode("overwrite").parquet(f"{table.path}/live/version=1")
    return table


def load(spark: SparkSession, path: str) -> BucketTable:
    """The newest version of the table at ``path``."""
    path = path.rstrip("/")
    about = spark.read.parquet(f"{path}/about").first()
    version = spark.read.parquet(f"{path}/live").agg(F.max("version")).first()[0]
    return BucketTable(spark, path, int(version), about["key"], about["buckets"], tuple(about["columns"]))
