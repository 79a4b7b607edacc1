"""Customer ledgers, exit verdicts and alert cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alert levels in rising order. Fixed values.
LEVELS = ["CLEAR", "WARNING", "REVIEW", "HIGH_RISK"]


def verdict(unpaid: Column, paid: Column) -> Column:
    return F.when((unpaid > 0) & (paid == 0), "HIGH_RISK").when(unpaid > 0, "REVIEW").otherwise("CLEAR")


def visit_kind(removed: Column, added: Column, direction: Column, covered: Column) -> Column:
    """What a shelf visit was, from what left, what came, the slot's change and whether a touch covers it."""
    return (
        F.when((removed > 0) & (added > 0), "MOVE").when(removed > 0, "TAKE").when(added > 0, "RETURN")
        .when(direction == "DECREASED", "TAKE").when(direction == "INCREASED", "RETURN").when(direction == "CHANGED", "TOUCH").when(covered, "TOUCH").otherwise("LOOK")
    )


def ledger_as_of(actions: DataFrame, moments: DataFrame, person: str, time: str) -> DataFrame:
    """For each moment (person, time, exit_id): items taken and paid by then.

    actions: person, time (when it is known), taken (+ take, - return), paid. At one instant actions come before moments.
    One sort per person instead of a range join.
    """
    a = actions.select(person, time, "taken", "paid", F.lit(0).alias("_m"), F.lit(None).cast("bigint").alias("exit_id"))
    m = moments.select(person, time, F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("paid"), F.lit(1).alias("_m"), "exit_id")
    w = Window.partitionBy(person).orderBy(time, "_m").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    u = a.unionByName(m).withColumn("t", F.sum("taken").over(w)).withColumn("p", F.sum("paid").over(w)).where("_m = 1")
    taken, paid = F.greatest(F.col("t"), F.lit(0)), F.col("p")
    out = u.select(person, time, "exit_id", taken.alias("taken"), paid.alias("paid"), F.greatest(taken - paid, F.lit(0)).alias("unpaid"))
    return out.withColumn("level", verdict(F.col("unpaid"), F.col("paid")))


def hold_and_release(at_exit: DataFrame, released: DataFrame) -> DataFrame:
    """HIGH_RISK at the exit is shown as WARNING and judged again after the hold."""
    r = released.select("exit_id", F.col("level").alias("final_level"), F.col("unpaid").alias("final_unpaid"))
    return at_exit.withColumn("shown", F.when(F.col("level") == "HIGH_RISK", "WARNING").otherwise(F.col("level"))).join(r, "exit_id")


def swap_gate(verdicts: DataFrame, level: str, consistency: str, least: float = 0.78) -> DataFrame:
    """A known low consistency lowers HIGH_RISK to REVIEW; an unknown one keeps it, with a note."""
    low = (F.col(level) == "HIGH_RISK") & (F.col(consistency) < least)
    return verdicts.withColumn("gated", F.when(low, "REVIEW").otherwise(F.col(level))).withColumn("note", F.when(low, "identity uncertain").when((F.col(level) == "HIGH_RISK") & F.col(consistency).isNull(), "identity not checked"))


def exit_outcome(obs: DataFrame, person: str, time: str, tie: str, at_exit: Column, confirm: int, end_of_stream: Column) -> DataFrame:
    """Each exit visit: confirmed when the person stays away for `confirm`, retracted on an earlier return, open at the end."""
    w = Window.partitionBy(person).orderBy(time, tie)
    d = obs.withColumn("_back", F.lead(time).over(w)).where(at_exit)
    away = F.col("_back") - F.col(time)
    state = F.when(away >= confirm, "confirmed").when(away.isNotNull(), "retracted").when(end_of_stream - F.col(time) >= confirm, "confirmed").otherwise("open")
    return d.select(person, F.col(time).alias("exit_ms"), state.alias("outcome"), F.col("_back").alias("back_ms"))


def dwell_payments(stays: DataFrame, actions: DataFrame, person: str) -> DataFrame:
    """Payment by dwelling: each qualifying stay (person, end_ms) tops the paid count up to what is taken by then.

    So paid is the running maximum of the taken count over stays, and each stay pays the step.
    """
    a = actions.select(person, F.col("known_at").alias("t"), F.col("taken").alias("d"), F.lit(0).alias("_m"))
    s = stays.select(person, F.col("end_ms").alias("t"), F.lit(0).cast("bigint").alias("d"), F.lit(1).alias("_m"))
    w = Window.partitionBy(person).orderBy("t", "_m").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    u = a.unionByName(s).withColumn("taken", F.greatest(F.sum("d").over(w), F.lit(0))).where("_m = 1")
    before = Window.partitionBy(person).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return u.withColumn("_p", F.coalesce(F.max("taken").over(before), F.lit(0))).select(person, F.col("t").alias("end_ms"), "taken", F.greatest(F.col("taken") - F.col("_p"), F.lit(0)).alias("pays"))


def case_fold(events: DataFrame, keys: list[str], order: list[str], level: str, resolution: str) -> DataFrame:
    """Case state after a key's events in order; a row has a level, or a resolution, or neither.

    A new case is active when its level alarms, else pass. A higher level raises it, notifies and reopens a resolved
    case; CLEAR lowers an open WARNING to auto_cleared; anything else only refreshes. A fold over one case's events.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(level)) - 1
    rows = events.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.when(F.col(level).isNotNull(), rank).otherwise(-1).cast("int").alias("r"), F.col(resolution).isNotNull().alias("x")))), lambda s: F.struct(s["r"].alias("r"), s["x"].alias("x"))).alias("_e"))
    kind = "struct<level:int,state:string,notified:int,reopened:int>"
    start = F.struct(F.lit(-1).alias("level"), F.lit("none").alias("state"), F.lit(0).alias("notified"), F.lit(0).alias("reopened")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        make = lambda lv, st, no, re: F.struct(lv.alias("level"), st.alias("state"), no.alias("notified"), re.alias("reopened")).cast(kind)
        one, zero = F.lit(1), F.lit(0)
        new = s["level"] < 0
        up = e["r"] > s["level"]
        return (
            F.when(e["x"] & ~new, make(s["level"], F.lit("resolved"), s["notified"], s["reopened"]))
            .when(e["r"] < 0, s)
            .when(new, make(e["r"], F.when(e["r"] > 0, "active").otherwise("pass"), F.when(e["r"] > 0, one).otherwise(zero), zero))
            .when(up, make(e["r"], F.lit("active"), s["notified"] + 1, s["reopened"] + F.when(s["state"] == "resolved", one).otherwise(zero)))
            .when((e["r"] == 0) & (s["level"] == 1) & (s["state"] != "resolved"), make(zero, F.lit("auto_cleared"), s["notified"], s["reopened"]))
            .otherwise(s)
        )

    out = rows.withColumn("_s", F.aggregate("_e", start, step)).where("_s.level >= 0")
    return out.select(*keys, F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_s.level") + 1).alias("level"), "_s.state", "_s.notified", "_s.reopened")


@dataclass
class Case:
    """The rules of case_fold, one event at a time: what streams carry from batch to batch."""

    level: int = -1
    state: str = "none"
    notified: int = 0
    reopened: int = 0

    def event(self, level: str | None, resolved: bool) -> None:
        rank = LEVELS.index(level) if level in LEVELS else -1
        if resolved and self.level >= 0:
            self.state = "resolved"
        elif rank > self.level:
            alarms, new = rank > 0, self.level < 0
            self.reopened += self.state == "resolved"
            self.notified += alarms
            self.level, self.state = rank, "active" if alarms or not new else "pass"
        elif rank == 0 and self.level == 1 and self.state != "resolved":
            self.level, self.state = 0, "auto_cleared"

    @property
    def name(self) -> str | None:
        return LEVELS[self.level] if self.level >= 0 else None


def notification(state: Column, notified: Column, shown: Column) -> Column:
    """show, cancel or none."""
    return F.when((state == "active") & (notified > 0), "show").when(shown & (state != "active"), "cancel").otherwise("none")


def cart_lines(ops: DataFrame, session: str, order: list[str], kind: str, item: str, qty: str) -> DataFrame:
    """What each cart holds when it is cleared or checked out, or at the end.

    kind: add (once), set, remove, clear, checkout. Sessions are cut at clear and checkout by a window; within a cut the
    operations on one item fold on their own.
    """
    w = Window.partitionBy(session).orderBy(*order)
    cut = F.coalesce(F.sum(F.col(kind).isin("clear", "checkout").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = ops.withColumn("cart_no", cut)
    ends = d.where(F.col(kind).isin("clear", "checkout")).select(session, "cart_no", F.col(kind).alias("closed_by"))
    code = F.when(F.col(kind) == "add", -1).when(F.col(kind) == "remove", 0).otherwise(F.greatest(F.col(qty), F.lit(0))).cast("int")
    e = d.where(F.col(kind).isin("add", "set", "remove")).groupBy(session, "cart_no", item).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, code.alias("c")))), lambda s: s["c"]).alias("_o"))
    q = F.aggregate("_o", F.lit(0), lambda a, c: F.when(c == -1, F.greatest(a, F.lit(1))).when(c == 0, F.lit(0)).when(a > 0, c).otherwise(F.lit(0)))
    return e.withColumn("qty", q).where("qty > 0").drop("_o").join(ends, [session, "cart_no"], "left").withColumn("closed_by", F.coalesce("closed_by", F.lit("open")))


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key (an older or equal version never replaces it)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*")


def stale_spans(msgs: DataFrame, keys: list[str], time: str, tie: str, silent: int) -> DataFrame:
    """When a device was stale: from `silent` after a message until the next."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    d = msgs.withColumn("restored_ms", F.lead(time).over(w))
    return d.where(F.col("restored_ms") - F.col(time) > silent).select(*keys, (F.col(time) + silent).alias("stale_ms"), "restored_ms")


def edges(rows: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Rows where a flag starts or ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("_f", flag).withColumn("_b", F.coalesce(F.lag("_f").over(w), F.lit(False)))
    return d.where(F.col("_f") != F.col("_b")).withColumn("edge", F.when(F.col("_f"), "start").otherwise("end")).drop("_f", "_b")


def owner_cascade(reach: Column, link: Column, touch: Column, band: Column) -> tuple[Column, Column]:
    """(owner, how): the first of a single reach owner, the linked one, a single touch owner, touch within reach, a single band owner; else -1."""
    single = lambda s: F.when(F.size(s) == 1, F.element_at(s, 1))
    both = F.array_intersect(touch, reach)
    picks = [("reach", single(reach)), ("link", link), ("touch", single(touch)), ("touch_reach", single(both)), ("band", single(band))]
    return F.coalesce(*[p for _, p in picks], F.lit(-1)), F.coalesce(*[F.when(p.isNotNull(), F.lit(n)) for n, p in picks], F.lit("unknown"))


def sensor_units(delta: Column, unit: Column) -> Column:
    """Items a weight change stands for: at least one, rounded half to even."""
    return F.when(unit > 0, F.greatest(F.lit(1), F.bround(F.abs(delta) / unit).cast("int"))).otherwise(F.lit(1))
