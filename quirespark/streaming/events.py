"""Event lines of running conversions: parsing, a batch fold, and its streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Stages in order with their weights.
STAGES = (("detect", 0.05), ("extract", 0.60), ("clean", 0.15), ("build", 0.15), ("verify", 0.05))
EVENT = "event string, ts double, task string, name string, stage string, state string, current long, total long, shards long, attempt long, code string, message string"

STATE = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("status", T.StringType()), T.StructField("active", T.StringType()), T.StructField("progress", T.DoubleType()),
    T.StructField("shard", T.LongType()), T.StructField("shards", T.LongType()), T.StructField("warnings", T.LongType()), T.StructField("retries", T.LongType()),
    T.StructField("code", T.StringType()), T.StructField("events", T.LongType()),
])


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; anything but an object with a text 'event' is left out."""
    e = lines.select(F.from_json(F.col(column), EVENT).alias("e")).where(F.col("e.event").isNotNull() & F.trim(F.col(column)).startswith("{"))
    return e.select("e.*")


def rescaled(index, outer, current, total, scale: int = 1000):
    """Progress within step ``index`` of ``outer`` as progress of the whole: (current, total) columns."""
    return (index - 1) * scale + F.least(F.lit(scale), F.bround(F.lit(scale) * current / total).cast("long")), outer * scale


def fresh(task: str) -> dict:
    return {"task": task, "status": "running", "active": None, "peak": 0.0, "done": [], "detail": None, "shard": 0, "shards": 0, "warnings": 0, "retries": 0, "code": None, "events": 0}


def step(s: dict, e: dict) -> dict:
    """The state of a task after one more event. Progress only ever rises; complete, skip and error are different ends."""
    kind = e.get("event")
    s["events"] += 1
    weight = dict(STAGES)
    if kind == "stage" and e.get("name") in weight:
        if e.get("state") == "start":
            s.update(active=e["name"], detail=None, status="running")
        else:
            if e["name"] not in s["done"]:
                s["done"].append(e["name"])
            s.update(active=None if s["active"] == e["name"] else s["active"], detail=None)
    elif kind == "progress":
        now, total = e.get("current") or 0, e.get("total") or 0
        if e.get("stage") == s["active"] and s["active"] and total > 0:
            s["detail"] = min(1.0, now / total)
        if s["shards"] and total == s["shards"] and now > s["shard"]:
            s["shard"] = now
    elif kind in ("shards", "plan") and (e.get("total") or e.get("shards") or 0) > 1:
        s.update(shard=0, shards=e.get("total") or e.get("shards"))
    elif kind == "warning":
        s["warnings"] += 1
    elif kind == "retry":
        s["retries"] = max(s["retries"], e.get("attempt") or 1)
        s["status"] = "retrying"
    elif kind == "error":
        s.update(status="failed", active=None, detail=None, code=e.get("code"))
    elif kind == "skip":
        s.update(status="skipped", active=None, detail=None, code=None)
    elif kind == "complete":
        s.update(status="complete", active=None, detail=None, done=[n for n, _ in STAGES])
    raw = sum(weight[n] for n in s["done"]) + (weight.get(s["active"], 0) * (s["detail"] or 0) if s["active"] not in s["done"] else 0)
    s["peak"] = max(s["peak"], min(1.0, raw), 1.0 if s["status"] == "skipped" else 0.0)
    return s


def _row(s: dict) -> dict:
    return {"task": s["task"], "status": s["status"], "active": s["active"], "progress": round(s["peak"], 6), "shard": s["shard"], "shards": s["shards"], "warnings": s["warnings"], "retries": s["retries"], "code": s["code"], "events": s["events"]}


def fold(events: DataFrame) -> DataFrame:
    """One row per task: its state after all events in order of ts.

    Tasks are sorted within partitions and run through batch by batch, so that no task's events are ever held at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s: dict | None = None
        for b in batches:
            out = []
            for e in b.astype(object).where(b.notna(), None).to_dict("records"):
                if s is None or s["task"] != e["task"]:
                    if s is not None:
                        out.append(_row(s))
                    s = fresh(e["task"])
                s = step(s, e)
            yield pd.DataFrame(out, columns=[f.name for f in STATE.fields])
        if s is not None:
            yield pd.DataFrame([_row(s)])

    return events.where("task is not null").repartition("task").sortWithinPartitions("task", "ts").mapInPandas(run, STATE)


_KEPT = T.StructType([T.StructField("json", T.StringType())])


def fold_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same fold over a stream: after each batch, the new state of the tasks that had events.

    For a stream that runs on, give idle_ms: the state of a task without events for so long (processing time) is
    dropped, and events after that begin a new one. Runs that end when they have read all (availableNow) keep the
    state in the checkpoint instead, as a query with such a clock never ends by itself.
    """
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else fresh(key[0])
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for e in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            s = step(s, e)
        state.update((json.dumps(s),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([_row(s)])

    return events.groupBy("task").applyInPandasWithState(run, STATE, _KEPT, "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type in tumbling windows with a watermark (works on batches and streams)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
