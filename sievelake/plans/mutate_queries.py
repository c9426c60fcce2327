"""Registered queries: insert, update, upsert and delete."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..operators import buckets, metrics, mutate, synth
from ..operators.ranking import sample_exact
from ..session import scratch_path, stored
from ..streaming import ingest
from . import fixtures as fx
from .sqltext import keyed_sql
from .synth_queries import INCREMENT, SHOWN, sample_sql, shown

QUERIES, SQL = {}, {}


def register(key: str, oracle: str | None = None):
    def keep(build):
        QUERIES[key] = build
        if oracle is not None:
            SQL[key] = oracle
        return build

    return keep


BUMPED = f"""list_transform(image_vec, lambda x, i: CASE WHEN i - 1 =
    {keyed_sql('id', mutate.BUMP_STREAM)} % 64 THEN CASE WHEN x < 255 THEN x + 1 ELSE x - 1 END
    ELSE x END)"""
MOVED = "least(greatest(eq_val + 1, 0), 65535)"
WORK = {
    **INCREMENT,
    "grown": "SELECT * FROM corpus_u8 UNION ALL SELECT * FROM inc",
    "upd": f"SELECT id, {BUMPED} AS image_vec, {MOVED} AS eq_val, range_val, tags FROM inc",
    "del": sample_sql("inc", "(SELECT count(*) // 2 FROM inc)", fx.DELETE_STREAM),
    "shrunk": "SELECT * FROM grown WHERE id NOT IN (SELECT id FROM del)",
    "upserted": """SELECT * FROM shrunk WHERE id NOT IN (SELECT id FROM upd)
                   UNION ALL SELECT * FROM upd""",
}


def work_sql(body: str) -> str:
    return fx.sql(body, "corpus_u8", **WORK)


class Work:
    """The tables a mutation starts from."""

    def __init__(self, spark, folder):
        self.base = fx.quantized_corpus(spark, folder)
        self.rows = fx.plain_corpus(spark, folder).count()
        self.inc = stored(synth.incremental_generate(self.base, fx.INCREMENT_RATIO), "increment")
        self.inc_rows = int(self.rows * fx.INCREMENT_RATIO)

    @property
    def grown(self):
        return mutate.insert_append(self.base, self.inc)

    @property
    def deleted(self):
        return sample_exact(self.inc, self.inc_rows // 2, "id", fx.DELETE_STREAM).select("id")

    @property
    def shrunk(self):
        """Grown, then half of the new rows deleted: an upsert of all of them does both."""
        return mutate.delete_by_ids(self.grown, self.deleted)

    @property
    def updates(self):
        return mutate.generate_updates(self.inc)


@register("insert_append", work_sql(SHOWN.format(rows="grown")))
def insert_append(spark, folder):
    return shown(Work(spark, folder).grown)


@register(
    "update_scalar_delta",
    work_sql("SELECT id, eq_val AS old_val, least(greatest(eq_val + 65530, 0), 65535) AS eq_val FROM inc"),
)
def update_scalar_delta(spark, folder):
    """A delta so large that most values are clipped."""
    rows = Work(spark, folder).inc
    return rows.select(
        "id",
        F.col("eq_val").alias("old_val"),
        mutate.saturating_delta(F.col("eq_val"), 65530).alias("eq_val"),
    )


@register("update_vector_bump", work_sql(SHOWN.format(rows="upd")))
def update_vector_bump(spark, folder):
    return shown(Work(spark, folder).updates)


@register("upsert_full", work_sql(SHOWN.format(rows="upserted")))
def upsert_full(spark, folder):
    """Every row comes twice, first as it was, then changed: the later one wins."""
    work = Work(spark, folder)
    changes = work.inc.withColumn("seq", F.lit(1)).unionByName(
        work.updates.withColumn("seq", F.lit(2))
    )
    return shown(mutate.upsert_full(work.shrunk, changes, sequence="seq"))


@register("merge_bucketed", work_sql(SHOWN.format(rows="upserted")))
def merge_bucketed(spark, folder):
    """The same delete and upsert on a stored table, of which only the buckets with changes are written anew."""
    work = Work(spark, folder)
    table = buckets.create(work.grown, scratch_path(spark, "buckets"), buckets=64)
    changes = work.inc.withColumn("seq", F.lit(1)).unionByName(work.updates.withColumn("seq", F.lit(2)))
    return shown(table.delete(work.deleted).upsert(changes, sequence="seq").rows())


@register(
    "upsert_partial",
    work_sql(
        """SELECT coalesce(b.id, u.id) AS id,
             array_to_string(coalesce(u.image_vec, b.image_vec), ',') AS vec,
             coalesce(u.eq_val, b.eq_val) AS eq_val, b.range_val,
             array_to_string(b.tags, ',') AS tags
           FROM shrunk b FULL OUTER JOIN upd u ON u.id = b.id"""
    ),
)
def upsert_partial(spark, folder):
    work = Work(spark, folder)
    changed = mutate.upsert_partial(work.shrunk, work.updates, ["image_vec", "eq_val"])
    return shown(changed)


@register(
    "overwrite_field",
    work_sql(
        """SELECT b.id, coalesce(u.eq_val, b.eq_val) AS eq_val, b.range_val
           FROM shrunk b LEFT JOIN upd u ON u.id = b.id"""
    ),
)
def overwrite_field(spark, folder):
    work = Work(spark, folder)
    return mutate.overwrite_field(work.shrunk, work.updates, "eq_val").select(
        "id", "eq_val", "range_val"
    )


@register(
    "update_where_in",
    work_sql(
        """SELECT id, CASE WHEN id IN (SELECT id FROM del) THEN eq_val + 1 ELSE eq_val END AS eq_val
           FROM grown"""
    ),
)
def update_where_in(spark, folder):
    work = Work(spark, folder)
    changed = mutate.update_where_in(work.grown, work.deleted, "eq_val", F.col("eq_val") + 1)
    return changed.select("id", "eq_val")


@register("delete_by_ids", work_sql(SHOWN.format(rows="shrunk")))
def delete_by_ids(spark, folder):
    return shown(Work(spark, folder).shrunk)


@register("delete_by_range", work_sql(SHOWN.format(rows="corpus_u8")))
def delete_by_range(spark, folder):
    """Deleting the id range of the inserted rows leaves the table as it was."""
    work = Work(spark, folder)
    ends = work.inc.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    return shown(mutate.delete_by_range(work.grown, ends["first"], ends["last"]))


@register("stream_ingest_upsert", work_sql(SHOWN.format(rows="upserted")))
def stream_ingest_upsert(spark, folder):
    work = Work(spark, folder)
    root = scratch_path(spark, "ingest")
    work.updates.repartition(4, "id").write.parquet(f"{root}/incoming")
    query = ingest.start_upserts(
        spark, f"{root}/incoming", work.base.schema, f"{root}/log", f"{root}/checkpoint"
    )
    query.awaitTermination()
    return shown(ingest.merged(work.shrunk, f"{root}/log"))


@register(
    "stream_ordered_changes",
    fx.sql(
        """SELECT id, eq_val FROM corpus WHERE id % 2 = 1
           UNION ALL SELECT id, eq_val + 100 FROM corpus WHERE id % 2 = 0 AND id % 10 <> 0
           UNION ALL SELECT id + 1000000, eq_val + 300 FROM corpus WHERE id % 3 = 0""",
        "corpus",
    ),
)
def stream_ordered_changes(spark, folder):
    """Changes and deletes that arrive before those they replace, and once more after all others."""
    rows = fx.plain_corpus(spark, folder).drop("image_vec")
    base = rows.withColumn("seq", F.lit(0).cast("bigint"))
    schema = "id bigint, eq_val int, seq bigint, gone boolean"

    def change(where: str, add: int, seq: int, gone: str = "false", move: int = 0):
        found = rows.where(where).selectExpr(
            f"id + {move}L AS id", f"eq_val + {add} AS eq_val", f"{seq}L AS seq", f"{gone} AS gone"
        )
        return found.coalesce(1)

    root = scratch_path(spark, "changes")
    newest = change("id % 2 = 0", 100, 2, "id % 10 = 0")
    for part in (newest, change("id % 3 = 0", 300, 1, move=1000000), change("id % 2 = 0", 200, 1), newest):
        part.write.mode("append").parquet(f"{root}/incoming")
    query = ingest.start_upserts(
        spark, f"{root}/incoming", T.StructType.fromDDL(schema), f"{root}/log", f"{root}/checkpoint"
    )
    query.awaitTermination()
    return ingest.ordered(base, f"{root}/log", "seq", deleted="gone").drop("seq")


PHASES = {
    "signup": "insert", "view": "insert", "click": "update", "purchase": "update", "error": "delete"
}


@register(
    "mutation_time",
    """SELECT CASE WHEN event_type IN ('signup', 'view') THEN 'insert'
              WHEN event_type IN ('click', 'purchase') THEN 'update' ELSE 'delete' END AS phase,
              CAST(count(*) AS BIGINT) AS operations, round(sum(value), 4) AS seconds
       FROM events GROUP BY 1""",
)
def mutation_time(spark, folder):
    phase = None
    for kind, name in PHASES.items():
        test = F.col("event_type") == kind
        phase = F.when(test, name) if phase is None else phase.when(test, name)
    log = fx.table(spark, folder, "events").select(
        phase.alias("phase"), F.col("value").alias("seconds")
    )
    return metrics.mutation_time(log).withColumn("seconds", F.round("seconds", 4))
