"""Streaming forms of the operators. State steps are the ones the batch forms use, so both give the same rows."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import Case
from ..operators.machines import LANE_EVENTS, Hysteresis, LaneCounter, lane_samples


def sensor_windows(stream: DataFrame, key: str, time: str, value: str, width: str, late: str) -> DataFrame:
    """Tumbling windows of each key: count, least, greatest, sum; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Dwell sessions: a session ends when no row comes for the gap."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))


def _restore(kind, saved: str | None, params: dict):
    m = kind(**params)
    if saved:
        for k, v in json.loads(saved).items():
            setattr(m, k, deque(v) if k in ("recent", "last") else v)
    return m


def _saved(m, skip: tuple[str, ...]) -> str:
    return json.dumps({k: list(v) if isinstance(v, deque) else v for k, v in asdict(m).items() if k not in skip})


def _stateful(stream: DataFrame, key: str, time: str, out: str, step: Callable[[pd.DataFrame, str | None], tuple[list[tuple], str]], expire: int | None) -> DataFrame:
    """A keyed machine whose state is text; rows of a batch are taken in the order that step sorts them.

    With `expire` (ms of event time) a key is forgotten, its open alert or count with it, when the watermark, which
    trails the newest row by `expire`, has passed its own newest row by as much; its next row begins anew, and rows later
    than the watermark are dropped. So state grows with the keys of the last two `expire`, not with all keys ever seen.
    """
    kind = stream.schema[key].dataType.simpleString()
    names = [key] + [f.split()[0] for f in out.split(", ")]
    if expire is not None:
        stream = stream.withColumn("_event", F.timestamp_millis(time)).withWatermark("_event", f"{expire} milliseconds")

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved, newest = state.get if state.exists else (None, None)
        pdf = pd.concat(list(batches), ignore_index=True)
        rows, saved = step(pdf, saved)
        newest = max(int(pdf[time].max()), newest or 0)
        state.update((saved, newest))
        if expire is not None:
            state.setTimeoutTimestamp(newest + expire)
        yield pd.DataFrame([(k[0], *r) for r in rows], columns=names).astype({n: "Int64" for n, t in (f.split() for f in out.split(", ")) if t in ("long", "int")})

    timeout = GroupStateTimeout.NoTimeout if expire is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", "saved string, newest long", "append", timeout)


def alert_stream(stream: DataFrame, key: str, time: str, tie: str, score: str, expire: int | None = None, **params) -> DataFrame:
    """Ended alerts of each key (the batch form's rows that have an end)."""
    skip = tuple(params)

    def step(pdf, saved):
        m = _restore(Hysteresis, saved, params)
        rows = sorted(zip(pdf[time].tolist(), pdf[tie].tolist(), pdf[score].tolist(), strict=True))
        ended = [e for t, _, s in rows if (e := m.step(t, s))]
        return [(e["start_ms"], e["end_ms"], e["peak"], e["hits"]) for e in ended], _saved(m, skip)

    return _stateful(stream.select(key, time, tie, score), key, time, "start_ms long, end_ms long, peak double, hits int", step, expire)


def lane_stream(stream: DataFrame, lane: str, time: str, tie: str, distance: str, refs: list[float], restock: str | None = None, status: str | None = None, late: str | None = None, expire: int | None = None, **params) -> DataFrame:
    params = {"refs": tuple(refs), **params}
    samples, more = lane_samples(time, tie, distance, restock=restock, status=status, late=late)

    def step(pdf, saved):
        m = _restore(LaneCounter, saved, params)
        return [tuple(e.values()) for t, v, flags in samples(pdf) for e in m.step(t, v, **flags)], _saved(m, tuple(params))

    return _stateful(stream.select(lane, time, tie, distance, *more), lane, time, LANE_EVENTS, step, expire)


def scan_gate_stream(stream: DataFrame, key: str, time: str, tie: str, code: str, quiet: int, expire: int | None = None) -> DataFrame:
    """Scans that are not a quick repeat of the one before."""

    def step(pdf, saved):
        last = json.loads(saved) if saved else None
        out = []
        for t, i, c in sorted(zip(pdf[time].tolist(), pdf[tie].tolist(), pdf[code].tolist(), strict=True)):
            if last is None or last[1] != c or t - last[0] >= quiet:
                out.append((t, i, c))
            last = [t, c]
        return out, json.dumps(last)

    return _stateful(stream.select(key, time, tie, code), key, time, f"{time} long, {tie} long, {code} string", step, expire)


def upsert_sink(path: str, keys: list[str], version: str):
    """foreachBatch writer: appends each batch once; `latest_of` reads the newest row of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    return write


def latest_of(spark, path: str, keys: list[str], version: str) -> DataFrame:
    from ..operators.ledger import latest

    return latest(spark.read.parquet(path).drop("batch"), keys, [version, "_batch"]).drop("_batch")


def case_stream(stream: DataFrame, key: str, time: str, tie: str, level: str, resolution: str) -> DataFrame:
    """Every row with its case as it stands after it (case_level, case_state, notified, reopened; null before a case begins).

    A case's last state is kept by the stream, so a batch reads its own rows only, however long the history is. Rows of one
    batch are taken in order of time and tie; batches in the order in which they come.
    """
    from .timers import keyed_machine

    rest = [c for c in stream.columns if c not in (key, time, tie)]

    def step(case: Case, row: dict) -> tuple:
        case.event(row[level], row[resolution] is not None)
        return case.name, case.state if case.level >= 0 else None, case.notified, case.reopened

    return keyed_machine(stream, key, time, tie, rest, Case, step, "case_level string, case_state string, notified int, reopened int")


def case_store(path: str, keys: list[str], order: list[str], level: str, resolution: str):
    """foreachBatch writer of a case_stream into three tables: events, resolutions, and the row of every case that the batch touches.

    A folder a batch, replaced if the batch runs again. Nothing that is stored is read.
    """
    case = ["case_level", "case_state", "notified", "reopened"]

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"batch={batch_id:010d}"
        batch = batch.where(F.col(level).isNotNull() | F.col(resolution).isNotNull()).persist()
        try:
            batch.where(F.col(resolution).isNull()).drop(*case).write.mode("overwrite").parquet(f"{path}/events/{at}")
            batch.where(F.col(resolution).isNotNull()).drop(*case).write.mode("overwrite").parquet(f"{path}/resolutions/{at}")
            last = batch.groupBy(*keys).agg(F.max_by(F.struct(*case), F.struct(*order)).alias("_c")).select(*keys, "_c.*")
            last.where("case_level is not null").withColumnsRenamed({"case_level": "level", "case_state": "state"}).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/cases/{at}")
        finally:
            batch.unpersist()

    return write


def latest_cases(spark, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each case of a case_store."""
    return latest_of(spark, f"{path}/cases", keys, "_batch")


def lane_sink(path: str, kind: str = "kind"):
    """foreachBatch writer of JSON lines: confirmed events (and device logs) to one folder, periodic status to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at, plain = f"batch={batch_id:010d}", [c for c in batch.columns if c != kind]
        batch.where(F.col(kind) != "STATUS").withColumn("message_type", F.when(F.col(kind) == "DEVICE_LOG", F.col(kind))).select(*plain, "message_type").write.mode("overwrite").json(f"{path}/events/{at}")
        batch.where(F.col(kind) == "STATUS").select(*plain).write.mode("overwrite").json(f"{path}/status/{at}")

    return write


def pour(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there now into a foreachBatch writer."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now into Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
