"""Resumable incremental log aggregation with Structured Streaming.

New log files dropped into ``src`` are folded into per-customer additive
state (the G2 bucket partials plus the last log date).  The state lives in
the streaming state store under ``checkpoint`` (exactly-once, survives
executor loss and restarts); each micro-batch emits the customers whose
state changed (``update`` mode), and ``foreachBatch`` commits them, tagged with
the batch id, to the ``TableStore`` at ``out`` together with the batch number.
A batch that is delivered again after a failure finds its number there and
commits nothing. When ``MAX_FOLDERS`` batches have piled up they are merged
into one folder with the latest row per customer, so reading never costs more
than the state and ``MAX_FOLDERS`` batches. All metrics are sums/counts/max,
so streaming equals batch. No watermark is needed: the cutoff filter (F1) is the late-data rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapsekit.operators.features import log_features_from_partials
from lapsekit.sources.store import Change, TableStore
from lapsekit.spec import USER_LOGS_SCHEMA, ObservationSpec

TABLE = "log_state"
#: Batches that may pile up before they are merged.
MAX_FOLDERS = 8


def run_incremental(spark: SparkSession, src: str, checkpoint: str, out: str, spec: ObservationSpec) -> None:
    """Process every file currently in ``src`` (``availableNow``) and stop.
    Re-running later only reads files that arrived since the last run."""
    sdf = spark.readStream.schema(USER_LOGS_SCHEMA).parquet(src)
    k = spec.key
    d = sdf.filter(F.col("date") <= spec.cutoff_int)
    # The batch G2 conditional sums plus max(date), as ONE stateful aggregate.
    agg = d.groupBy(k).agg(*_partial_exprs(spec), F.max("date").alias("last_log_date"))
    store = TableStore(spark, out)
    schema = state_schema(spark, spec)

    def sink(batch: DataFrame, batch_id: int) -> None:
        take_in(store, batch, batch_id)
        if len(store.snapshot().tables.get(TABLE, [])) >= MAX_FOLDERS:
            store.compact(TABLE, schema, lambda rows: latest(rows, spec))

    q = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def take_in(store: TableStore, batch: DataFrame, batch_id: int) -> None:
    """Commit a batch once, however often it is delivered. It is computed exactly once a delivery, as Spark demands."""
    folder = store.stage(TABLE, batch.withColumn("batch_id", F.lit(batch_id).cast("long")))

    def build(base):
        if int(base.properties.get("batch", -1)) >= batch_id:
            return None
        return Change(add={TABLE: folder}, properties={"batch": batch_id})

    store.transact(build)


def state_schema(spark: SparkSession, spec: ObservationSpec):
    empty = spark.createDataFrame([], USER_LOGS_SCHEMA).groupBy(spec.key).agg(*_partial_exprs(spec), F.max("date").alias("last_log_date"))
    return empty.withColumn("batch_id", F.lit(0).cast("long")).schema


def _partial_exprs(spec: ObservationSpec):
    from lapsekit.operators.features import BUCKET_NAMES, PLAY_COLS, log_bucket
    from lapsekit.functions import ymd_to_date

    b = log_bucket(F.datediff(F.lit(spec.cutoff), ymd_to_date("date")), spec)
    plays = sum(F.col(c) for c in PLAY_COLS)
    secs = F.when(F.col("total_secs").between(0, spec.secs_cap), F.col("total_secs"))
    out = []
    for i, n in enumerate(BUCKET_NAMES):
        inb = b == i
        out += [F.count_if(inb).alias(f"logdays_{n}"),
                F.sum(F.when(inb, F.col("num_unq"))).alias(f"num_unq_sum_{n}"),
                F.sum(F.when(inb, plays)).alias(f"total_plays_sum_{n}"),
                F.sum(F.when(inb, F.col("num_100"))).alias(f"num_100_sum_{n}"),
                F.sum(F.when(inb, secs)).alias(f"secs_sum_{n}"),
                F.count(F.when(inb, secs)).alias(f"secs_n_{n}")]
    return out


def latest(rows: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Latest row per customer (one window partitioned by the key; at most one row a batch and customer)."""
    w = Window.partitionBy(spec.key).orderBy(F.col("batch_id").desc())
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def current_state(spark: SparkSession, out: str, spec: ObservationSpec) -> DataFrame:
    """Latest committed state per customer."""
    return latest(TableStore(spark, out).read(TABLE, state_schema(spark, spec)), spec).drop("batch_id")


def incremental_log_features(spark: SparkSession, src: str, checkpoint: str, out: str,
                             spec: ObservationSpec) -> DataFrame:
    """Run T1 and derive the 17 log features (G3/G4) from the streamed state."""
    run_incremental(spark, src, checkpoint, out, spec)
    st = current_state(spark, out, spec)
    return log_features_from_partials(st, spec)
