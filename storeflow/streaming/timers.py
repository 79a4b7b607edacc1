"""Streams with event-time timers: rows wait in state until the watermark passes them, so that they are taken in order of
time however they came, and timers fire what falls due while no row comes.

Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`); `use_rocksdb` sets it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import exits


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Waiting(StatefulProcessor):
    """Holds a key's rows (time, tie, text) until the watermark has passed their time; `take` gets them in order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([T.StructField("t", T.LongType()), T.StructField("i", T.LongType()), T.StructField("row", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        self.rows.appendList(list(zip(pdf["t"].tolist(), pdf["i"].tolist(), pdf["row"].tolist(), strict=True)))
        self.handle.registerTimer(max(0, int(pdf["t"].min())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.rows.get()) if self.rows.exists() else []
        due, later = [r for r in rows if r[0] <= past], [r for r in rows if r[0] > past]
        if later:
            self.rows.put(later)
        elif rows:
            self.rows.clear()
        made, wake = self.take(due, past)
        wake = [w for w in (wake, later[0][0] if later else None) if w is not None]
        if wake:
            self.handle.registerTimer(max(past + 1, min(wake)))
        if made:
            yield pd.DataFrame([(*key, *r) for r in made], columns=self.names)

    def take(self, due: list[tuple], past: int) -> tuple[list[tuple], int | None]:
        """Rows to give out, and when to be woken."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Released(Waiting):
    def __init__(self, names: list[str]):
        self.names = names

    def take(self, due, past):
        return [(t, i, row) for t, i, row in due], None


class Machine(Waiting):
    """A machine of `exits`, stepped by the released rows and by its own deadlines; forgotten after `forget` ms without rows."""

    def __init__(self, kind, step, params: dict, names: list[str], forget: int | None):
        self.kind, self.step, self.params, self.names, self.forget = kind, step, params, names, forget

    def init(self, handle) -> None:
        super().init(handle)
        self.machine = handle.getValueState("machine", T.StructType([T.StructField("saved", T.StringType()), T.StructField("last", T.LongType())]))

    def take(self, due, past):
        text, last = self.machine.get() if self.machine.exists() else (None, None)
        machine, made = exits.restored(self.kind, json.loads(text) if text else None, **self.params), []
        for t, _, row in due:
            made += self.step(machine, t, *json.loads(row).values())
            last = t
        deadline = getattr(machine, "deadline", lambda: None)
        if deadline() is not None:
            made += machine.until(past, included=True)
        ends = None if self.forget is None or last is None else last + self.forget
        if ends is not None and ends <= past and deadline() is None:
            self.machine.clear()
            return made, None
        self.machine.update((json.dumps(exits.saved(machine)), last))
        return made, min([w for w in (deadline(), ends) if w is not None], default=None)


class Folded(StatefulProcessor):
    """A machine that takes rows as they come, in order within a batch, and adds to each what it says of it; no timers."""

    def __init__(self, kind, step, names: list[str]):
        self.kind, self.step, self.names = kind, step, names

    def init(self, handle) -> None:
        self.machine = handle.getValueState("machine", T.StructType([T.StructField("saved", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self.kind(**(json.loads(self.machine.get()[0]) if self.machine.exists() else {}))
        pdf = pd.concat(list(rows), ignore_index=True)
        made = [(*key, t, i, row, *self.step(machine, json.loads(row))) for t, i, row in sorted(zip(pdf["t"].tolist(), pdf["i"].tolist(), pdf["row"].tolist(), strict=True))]
        self.machine.update((json.dumps(vars(machine)),))
        yield pd.DataFrame(made, columns=self.names)

    def close(self) -> None:
        pass


def keyed_machine(stream: DataFrame, key: str, time: str, tie: str, rest: list[str], kind, step, out: str) -> DataFrame:
    """Rows of a stream with what step(machine, row) says of each; a key's machine is a dataclass of plain values."""
    use_rocksdb(stream.sparkSession)
    whole = f"t long, i long, row string, {out}"
    source = stream.select(key, F.col(time).cast("bigint").alias("t"), F.col(tie).cast("bigint").alias("i"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("row"))
    schema = T.StructType([stream.schema[key], *T._parse_datatype_string(whole).fields])
    got = source.groupBy(key).transformWithStateInPandas(Folded(kind, step, _names(key, whole)), schema, "Append", "None")
    fields = T.StructType([stream.schema[c] for c in rest])
    said = [f.split()[0] for f in out.split(", ")]
    order = [F.col("t").alias(time)] + ([F.col("i").alias(tie)] if tie != time else [])
    return got.select(key, *order, F.from_json("row", fields).alias("r"), *said).select(key, time, *([tie] if tie != time else []), "r.*", *said)


def _text(stream: DataFrame, key: str, time: str, tie: str, columns: list[str], late: int) -> DataFrame:
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return stream.select(key, F.col(time).cast("bigint").alias("t"), F.col(tie).cast("bigint").alias("i"), row.alias("row"), F.timestamp_millis(time).alias("at")).withWatermark("at", f"{late} milliseconds")


def _run(stream: DataFrame, key: str, processor: Waiting, out: str, source: DataFrame) -> DataFrame:
    schema = T.StructType([stream.schema[key], *T._parse_datatype_string(out).fields])
    return source.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def in_order(stream: DataFrame, key: str, time: str, tie: str, late: int) -> DataFrame:
    """Every row of a key once it is older than the newest by `late` ms, in order of time and tie; later ones are dropped.

    Columns: key, time, tie and the others. This is the release buffer of late feeds: what is due by now, and no sooner.
    """
    rest = [c for c in stream.columns if c not in (key, time, tie)]
    got = _run(stream, key, Released([key, "t", "i", "row"]), "t long, i long, row string", _text(stream, key, time, tie, rest, late))
    fields = T.StructType([stream.schema[c] for c in rest])
    return got.select(key, F.col("t").alias(time), F.col("i").alias(tie), F.from_json("row", fields).alias("r")).select(key, time, tie, "r.*")


def _names(key: str, out: str) -> list[str]:
    return [key, *(f.split()[0] for f in out.split(", "))]


def exit_stream(stream: DataFrame, person: str, time: str, tie: str, late: int, forget: int | None = None, **params) -> DataFrame:
    """`exits.exit_events` of a stream, without an end: vanishings and releases come from timers, not from rows."""
    source = _text(stream, person, time, tie, exits.EXIT_COLUMNS, late)
    return _run(stream, person, Machine(exits.ExitDesk, exits.desk_step, params, _names(person, exits.EXIT_EVENTS), forget), exits.EXIT_EVENTS, source)


def dwell_stream(stream: DataFrame, person: str, time: str, tie: str, late: int, forget: int | None = None, **params) -> DataFrame:
    """`exits.dwell_events` of a stream."""
    source = _text(stream, person, time, tie, exits.DWELL_COLUMNS, late)
    return _run(stream, person, Machine(exits.Till, exits.till_step, params, _names(person, exits.DWELL_EVENTS), forget), exits.DWELL_EVENTS, source)
