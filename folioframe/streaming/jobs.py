"""Job states from status events, as a stream and as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.ordering import row_places

# Default failure text, and the lifecycle of a publish job with the template state it implies.
FAILURE = "OCR job failed."
STATES = ("none", "queued", "running", "completed", "failed")
LEGAL = {("none", "queued"), ("queued", "running"), ("running", "completed"), ("queued", "failed"), ("running", "failed"),
         ("failed", "queued")}
TEMPLATE_STATUS = {"none": "validated", "queued": "embedding_pending", "running": "embedding_pending", "completed": "active",
                   "failed": "validated"}
BLOCK = 1000
HOUR_MICROS = 3_600_000_000.0


def job_states(events: DataFrame) -> DataFrame:
    """Current state per job. Only combinable aggregates, so it runs unchanged on a stream in update mode.

    events: job_id, ts, seq, status, payload.
    """
    def latest(value: str, when: str) -> F.Column:
        return F.expr(f"max_by({value}, struct(ts, seq)) FILTER (WHERE {when})")

    ended = "status IN ('completed', 'failed')"
    return events.groupBy("job_id").agg(
        F.expr("max_by(status, struct(ts, seq))").alias("status"),
        F.expr("min(ts) FILTER (WHERE status = 'queued')").alias("requested_at"),
        latest("ts", "status = 'processing'").alias("started_at"),
        latest("ts", ended).alias("completed_at"),
        F.expr(
            "max_by(CASE WHEN status = 'failed' THEN coalesce(payload, '" + FAILURE + "') END, struct(ts, seq)) FILTER (WHERE status <> 'queued')"
        ).alias("error_message"),
        latest("payload", "status = 'completed'").alias("result"),
    )


def poll(states: DataFrame) -> DataFrame:
    """What a client sees: the result when completed, the error when failed."""
    return states.selectExpr(
        "job_id", "status", "CASE WHEN status = 'completed' THEN result END AS result", "CASE WHEN status = 'failed' THEN error_message END AS error"
    )


def stream_job_states(events: DataFrame, sink: str, checkpoint: str):
    """Keep changed states as an append-only log; each micro-batch adds the jobs it touched."""

    def append(batch: DataFrame, batch_id: int) -> None:
        # The batch id names the folder, so a batch repeated after a failure replaces itself.
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        job_states(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(append).start()
    )


def read_job_states(spark: SparkSession, sink: str) -> DataFrame:
    """Newest logged state of each job."""
    log = spark.read.parquet(sink)
    values = [c for c in log.columns if c not in ("job_id", "batch_id")]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*values), "batch_id").alias("s")).select("job_id", "s.*")


def _step(state: str, event: str) -> str:
    """Next state as text over a state and an event expression."""
    cases = " ".join(f"WHEN {state} = '{a}' AND {event} = '{b}' THEN '{b}'" for a, b in sorted(LEGAL))
    return f"CASE {cases} ELSE {state} END"


def publish_flow(events: DataFrame) -> DataFrame:
    """Each publish event with the state it met and whether it was legal; illegal events change nothing.

    A block of events acts on a state like a small table from state to state, and such tables combine. Blocks
    are folded in parallel, the tables of a job are chained, and each block then replays from its own entry
    state, so even a job with very many events spreads over many tasks.
    """
    timed = events.withColumn("lead", F.unix_micros(F.col("ts").cast("timestamp")))
    placed = row_places(timed, ["job_id"], ["lead", "seq"], HOUR_MICROS)
    blocks = placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK)).groupBy("job_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("place", "seq", "status"))).alias("items")
    )
    names = "array(" + ", ".join(f"'{s}'" for s in STATES) + ")"
    table = f"map_from_arrays({names}, transform({names}, s -> aggregate(items, s, (a, e) -> {_step('a', 'e.status')})))"
    tables = blocks.select("job_id", "block", F.expr(table).alias("effect"))
    chained = tables.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("block", F.map_entries("effect").alias("effect")))).alias("chain"))
    entry = """aggregate(chain, named_struct('at', 'none', 'out', cast(array() AS array<struct<block:bigint,entry:string>>)), (a, b) ->
        named_struct('at', element_at(filter(b.effect, e -> e.key = a.at), 1).value, 'out', concat(a.out, array(named_struct('block', b.block, 'entry', a.at)))), a -> a.out)"""
    entries = chained.selectExpr("job_id", f"inline({entry})")
    replay = f"""aggregate(items, named_struct('at', entry, 'out', cast(array() AS array<struct<seq:bigint,status:string,before:string,legal:boolean>>)), (a, e) ->
        named_struct('at', {_step('a.at', 'e.status')}, 'out', concat(a.out, array(named_struct('seq', e.seq, 'status', e.status, 'before', a.at,
          'legal', {_step('a.at', 'e.status')} = e.status AND a.at <> e.status)))), a -> a.out)"""
    return blocks.join(entries, ["job_id", "block"]).selectExpr("job_id", f"inline({replay})")
