"""Batched upserts as a stream of files.

Every micro-batch is added to a change log, in the folder of its batch number: the cost of a batch
is the size of the batch, and a batch run again after a failure overwrites itself. Readers merge
the log over the base table, the last batch winning (``merged``) or the highest sequence of each key,
with deletes (``ordered``); ``compact`` writes a merge as a new base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import upsert_full


def start_upserts(
    spark: SparkSession,
    incoming: str,
    schema: T.StructType,
    log: str,
    checkpoint: str,
    files_per_batch: int = 1,
) -> StreamingQuery:
    """Read all files present, in batches, into the change log; ends when they are consumed."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (
        stream.parquet(incoming)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged(base: DataFrame, log: str, key: str = "id", sequence: str | None = None) -> DataFrame:
    """The base table with the change log applied.

    Changes of one batch are ordered by ``sequence``, if given; a later batch always wins.
    """
    changes = base.sparkSession.read.parquet(log)
    inner = F.col(sequence).cast("bigint") if sequence else F.lit(0).cast("bigint")
    ordered = changes.withColumn(
        "_order", F.struct(F.col("batch").cast("bigint").alias("batch"), inner.alias("inner"))
    )
    return upsert_full(base, ordered.select(*base.columns, "_order"), key, "_order")


def ordered(
    base: DataFrame,
    log: str,
    sequence: str,
    key: str = "id",
    deleted: str | None = None,
) -> DataFrame:
    """The base table with the highest change of every key applied, in whatever order the changes came.

    ``sequence`` orders the changes of a key and is a column of the log; where the base has it too, a change that
    is not above the stored row is late and ignored. A change whose ``deleted`` is true removes the row, also
    for changes with a lower sequence that arrive later. Of equal sequences the later batch wins, and the base
    loses none. Batches that are shuffled, repeated or late give the rows of a single batch. NULL sequences lose
    to all others, a NULL ``deleted`` is false, and changes without a key are an error.
    """
    changes = base.sparkSession.read.parquet(log)
    message = F.lit(f"a change has no {key}")
    known = changes.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(message)).otherwise(F.col(key)))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    columns = [c for c in base.columns if c != key]
    rank = F.struct(F.col(sequence).alias("at"), F.col("batch").cast("bigint").alias("batch"))
    row = F.struct(rank.alias("rank"), gone.alias("gone"), F.struct(*columns).alias("row"))
    newest = known.groupBy(key).agg(F.max_by(row, rank).alias("new"))  # reduced before its shuffle
    stored = base.select(F.col(key), F.struct(*[F.lit(True).alias("_stored"), *columns]).alias("old"))
    both = stored.join(newest, key, "full")
    wins = F.col("new").isNotNull()
    if sequence in columns:
        late = F.col(f"old.{sequence}") >= F.coalesce(F.col("new.rank.at"), F.col(f"old.{sequence}"))
        wins = wins & ~F.coalesce(late, F.lit(False))
    chosen = [F.when(wins, F.col(f"new.row.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    there = F.when(wins, ~F.col("new.gone")).otherwise(F.col("old").isNotNull())
    return both.where(there).select(key, *chosen).select(*base.columns)


def compact(
    base: DataFrame, log: str, path: str, key: str = "id", sequence: str | None = None
) -> DataFrame:
    """Write the merged table to a new path and read it back.

    The log stays as it is; changes after this belong into a new one.
    """
    merged(base, log, key, sequence).write.mode("errorifexists").parquet(path)
    return base.sparkSession.read.parquet(path)
