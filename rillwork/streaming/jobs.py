"""Jobs as a stream of events: legal state changes, progress, and repeated requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Which states may follow which; a state may follow itself.
NEXT = {"queued": ("running", "cancelled", "failed"), "running": ("retrying", "done", "partial", "failed", "cancelled"), "retrying": ("running", "failed", "cancelled"), "done": (), "partial": (), "failed": (), "cancelled": ()}


def folded(states: list[str], start: str = "queued") -> tuple[str, int]:
    """ST-01: (state after the events, illegal ones, which change nothing)."""
    now, bad = start, 0
    for s in states:
        if s == now:
            continue
        if s in NEXT.get(now, ()):
            now = s
        else:
            bad += 1
    return now, bad


def job_states(events: DataFrame) -> DataFrame:
    """ST-01 in batch: events(job_id, seq, state) -> job_id, state, refused: a fold in order of seq. A job has few events."""
    legal = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda e: e["state"])

    def step(s, e):  # noqa: ANN001, ANN202
        may = F.array_contains(F.try_element_at(legal, s["now"]), e)
        return F.struct(F.when(may, e).otherwise(s["now"]).alias("now"), (s["bad"] + ((e != s["now"]) & ~F.coalesce(may, F.lit(False))).cast("int")).alias("bad"))

    g = events.groupBy("job_id").agg(ordered.alias("all"))
    return g.select("job_id", F.aggregate("all", F.struct(F.lit("queued").alias("now"), F.lit(0).alias("bad")), step).alias("s")).select("job_id", F.col("s.now").alias("state"), F.col("s.bad").alias("refused"))


def job_states_stream(events: DataFrame) -> DataFrame:
    """ST-01 on a stream: the same fold with the state kept between batches; a row for each job that a batch touches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, bad = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        now, more = folded(rows["state"].tolist(), now)
        state.update((now, bad + more))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "refused": [bad + more]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, state string, refused int", "now string, bad int", "update", GroupStateTimeout.NoTimeout)


def first_requests(requests: DataFrame, minutes: int = 60) -> DataFrame:
    """ST-05: requests(key, ts): a request repeats an earlier one of its key if less than the time has passed since the last that counted; repeats are dropped. On a stream by watermark; in batch by a fold over a
    key's times, which are few."""
    if requests.isStreaming:
        return requests.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(["key"])
    rest = [c for c in requests.columns if c not in ("key", "ts")]
    g = requests.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", *rest))).alias("all"))
    kind = g.schema["all"].dataType.simpleString()

    def step(kept, x):  # noqa: ANN001, ANN202
        last = F.try_element_at(kept, F.lit(-1))["ts"]
        return F.when(last.isNull() | (x["ts"] >= last + F.expr(f"interval {minutes} minutes")), F.concat(kept, F.array(x))).otherwise(kept)

    counted = g.select("key", F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("x"))
    return counted.select(*[F.col("key") if c == "key" else F.col(f"x.{c}") for c in requests.columns])
