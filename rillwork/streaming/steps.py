"""Steps of jobs as rows: what a runner reports (start, finish, skip, fail, retry), the states that follow, forced settling, and sources that refused lately. The same folds hold for a batch and for a state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a report makes of a step, and how long a refusal is remembered, by kind.
AFTER = {"start": "running", "retry": "retrying", "finish": "done", "skip": "skipped", "fail": "failed"}
REMEMBERED_MINUTES = {"refused": 60, "unreachable": 10}


def report(job_id: Column, step: str, kind: str, seq: Column, text: Column | None = None) -> Column:
    """ST-08, X-32: one report of a runner as a row: struct(job_id, step, kind, seq, text)."""
    if kind not in AFTER:
        raise ValueError(f"no such report: {kind}")
    return F.struct(job_id.alias("job_id"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), seq.alias("seq"), (text if text is not None else F.lit(None).cast("string")).alias("text"))


def step_states(reports: DataFrame) -> DataFrame:
    """ST-08, X-32: reports(job_id, step, kind, seq, text) -> job_id, step, state by the last report, attempts (starts and retries), warnings (texts of reports that don't end the step in failure), error (the last failure's)."""
    table = F.create_map(*[F.lit(x) for kv in AFTER.items() for x in kv])
    g = reports.groupBy("job_id", "step").agg(
        F.max_by(F.try_element_at(table, F.col("kind")), "seq").alias("state"),
        F.count_if(F.col("kind").isin("start", "retry")).alias("attempts"),
        F.count_if(F.col("text").isNotNull() & (F.col("kind") != "fail")).alias("warnings"),
        F.max_by(F.when(F.col("kind") == "fail", F.col("text")), F.when(F.col("kind") == "fail", F.col("seq"))).alias("error"),
    )
    return g.withColumn("error", F.when(F.col("state") == "failed", F.col("error")))


def settled(steps: DataFrame, ended: DataFrame) -> DataFrame:
    """ST-03: steps(job_id, step, state, ...) of jobs whose runner has ended (ended(job_id)): what still ran has failed, what never started was skipped."""
    e = ended.select("job_id").distinct().withColumn("__ended", F.lit(True))
    state = F.when(F.col("__ended").isNull(), F.col("state")).when(F.col("state").isin("running", "retrying"), "failed").when(F.col("state") == "queued", "skipped").otherwise(F.col("state"))
    return steps.join(e, "job_id", "left").withColumn("state", state).drop("__ended")


def refusals_in_force(refusals: DataFrame, now: Column) -> DataFrame:
    """ST-06: refusals(key, kind, at) -> key, until, probe: the longest memory of each key, and whether it has run out, so that the source is asked again in the background."""
    minutes = F.try_element_at(F.create_map(*[F.lit(x) for kv in REMEMBERED_MINUTES.items() for x in kv]), F.col("kind"))
    until = F.col("at") + F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))
    return refusals.groupBy("key").agg(F.max(until).alias("until")).withColumn("probe", F.col("until") <= now)
