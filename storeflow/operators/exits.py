"""Who leaves, and with what: the exit machine and payment by dwelling, one small state a person.

Rows of a person are sightings and changes of the ledger, in order of time; a sighting tells where the feet are. The
machines are stepped row by row and hold no rows, in batch (`exit_events`, `dwell_events`) and in streams alike.

Times that pass without a row matter too: `ExitDesk.until(t)` fires what fell due before t. A row at the very moment of a
deadline comes first, so a person who is seen then has not vanished, and an item recorded then counts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from .grouped import stepped

EXIT_EVENTS = "at_ms long, level string, cause string, taken long, paid long, unpaid long, note string"
DWELL_EVENTS = "at_ms long, items long, kind string"
#: A person whose last sighting is this near the end of a recording is still in view, in ms. Fixed value.
IN_VIEW = 300


@dataclass
class ExitDesk:
    """The rules of one person's exit.

    approach: at the exit for `least` ms, once a visit (a visit ends after `rearm` ms away), WARNING if leaving now would be
    HIGH_RISK. outside: seen beyond the door for `least`. vanished: not seen for `confirm` ms, at most `rearm` after
    the exit or outside. Both end in a verdict, and only for persons seen inside (for `settle` ms). With `hold`, HIGH_RISK is
    shown as WARNING and judged again after so long (released). retracted: seen inside after all; judged anew from then.
    end: the recording stops while the person is leaving.
    A stay goes on over `grace` ms elsewhere. HIGH_RISK becomes REVIEW when the best likeness (`looks`) of the last
    `swap_window` ms inside is under `swap_least`.
    """

    least: int = 500
    confirm: int = 3000
    rearm: int = 2000
    grace: int = 0
    hold: int = 0
    settle: int = 0
    swap_least: float = 0.78
    swap_window: int = 5000

    taken: int = 0
    paid: int = 0
    seen: int | None = None
    near: int | None = None
    stay_from: int | None = None
    stay_left: int | None = None
    warned: bool = False
    street_from: int | None = None
    inside_from: int | None = None
    came_in: bool = False
    gone: bool = False
    held_from: int | None = None
    edge: bool = False
    looks: list = field(default_factory=list)
    checked: bool = False

    def _rule(self, cause: str, t: int, shown: bool = True) -> tuple:
        """One verdict of the ledger as it stands; shown: with the likeness check and the hold."""
        held = max(0, self.taken)
        owed = max(0, held - self.paid)
        level = "CLEAR" if not owed else "REVIEW" if self.paid else "HIGH_RISK"
        note = None
        if level == "HIGH_RISK" and shown:
            if self.looks:
                if max(v for _, v in self.looks) < self.swap_least:
                    level, note = "REVIEW", "identity uncertain"
            elif self.checked:
                note = "identity not checked"
        if level == "HIGH_RISK" and (cause == "approach" or shown and self.hold and cause in ("outside", "vanished")):
            if cause != "approach":
                self.held_from = t
            level = "WARNING"
        return t, level, cause, held, self.paid, owed, note

    def _leaving(self) -> bool:
        return self.came_in and not self.gone and self.near is not None and self.seen - self.near <= self.rearm

    def deadline(self) -> int | None:
        """When something falls due if no row comes."""
        due = [self.seen + self.confirm] if self._leaving() else []
        due += [self.held_from + self.hold] if self.held_from is not None and self.gone else []
        return min(due, default=None)

    def until(self, t: int, included: bool = False) -> list[tuple]:
        out = []
        while (due := self.deadline()) is not None and (due < t or included and due == t):
            if self.gone:
                self.held_from = None
                out.append(self._rule("released", due))
            else:
                self.gone = True
                out.append(self._rule("vanished", due))
        return out

    def ledger(self, t: int, taken: int, paid: int) -> list[tuple]:
        out = self.until(t)
        self.taken, self.paid = self.taken + taken, self.paid + paid
        return out

    def sighting(self, t: int, at_exit: bool, outside: bool, inside: bool | None = None, look: float | None = None, edge: bool = False, checked: bool = False) -> list[tuple]:
        out = self.until(t)
        if self.gone and not outside:
            self.gone, self.warned, self.stay_from, self.stay_left, self.held_from = False, False, None, None, None
            out.append((t, None, "retracted", max(0, self.taken), self.paid, max(0, max(0, self.taken) - self.paid), None))
        self._move(t, at_exit, outside, not outside if inside is None else inside)
        self.seen, self.edge, self.checked = t, edge, self.checked or checked
        if look is not None and self.stay_from is None and self.street_from is None and (self.near is None or t - self.near >= self.rearm):
            self.looks = [x for x in self.looks if x[0] >= t - self.swap_window] + [[t, look]]
        if self.stay_from is not None and not self.warned and self.came_in and t - self.stay_from >= self.least:
            self.warned = True
            verdict = self._rule("approach", t, shown=False)
            out += [verdict] if verdict[1] == "WARNING" else []
        if not self.gone and self.came_in and self.street_from is not None and t - self.street_from >= self.least:
            self.gone = True
            out.append(self._rule("outside", t))
        return out

    def _move(self, t: int, at_exit: bool, outside: bool, inside: bool) -> None:
        was_near = self.near
        self.street_from = (t if self.street_from is None else self.street_from) if outside else None
        self.inside_from = (t if self.inside_from is None else self.inside_from) if inside else None
        self.came_in = self.came_in or self.inside_from is not None and t - self.inside_from >= self.settle
        if at_exit or outside:
            self.near = t
        if at_exit:
            if self.stay_from is None:
                self.stay_from = t
                if self.stay_left is not None and t - self.stay_left >= self.rearm:
                    self.warned = False
            self.stay_left = None
        elif self.stay_from is not None and not (self.grace and was_near is not None and t - was_near <= self.grace):
            self.stay_from, self.stay_left = None, t

    def finish(self, end: int) -> list[tuple]:
        """The recording ends: what is held is released, and who was leaving has left."""
        out = self.until(end, included=True)
        if self.held_from is not None and self.gone:
            self.held_from = None
            out.append(self._rule("released", end))
        elif self._leaving() and (end - self.seen >= IN_VIEW or self.edge):
            self.gone = True
            hold, self.hold = self.hold, 0
            out.append(self._rule("end", end))
            self.hold = hold
        return out


@dataclass
class Till:
    """Payment by dwelling: who stands at the checkout for `pay` ms has paid what they hold, and what they still take while
    they stand there; who then goes to a shelf (overlap of at least `back`) has not."""

    pay: int = 1500
    back: float = 0.5
    grace: int = 0

    taken: int = 0
    paid: int = 0
    by_dwelling: int = 0
    since: int | None = None
    last: int | None = None

    def ledger(self, t: int, taken: int, paid: int) -> list[tuple]:
        self.taken, self.paid = self.taken + taken, self.paid + paid
        return []

    def sighting(self, t: int, checkout: bool, overlap: float) -> list[tuple]:
        if checkout:
            self.since = t if self.since is None else self.since
            self.last = t
        elif not (self.grace and self.last is not None and t - self.last <= self.grace):
            self.since = None
        if self.since is not None and t - self.since >= self.pay:
            owed = max(0, max(0, self.taken) - self.paid)
            before, self.by_dwelling = self.by_dwelling, max(self.by_dwelling, owed)
            return [(t, self.by_dwelling, "dwell")] if not before and owed else [(t, owed - before, "more")] if owed > before else []
        if self.by_dwelling and overlap >= self.back:
            cancelled, self.by_dwelling = self.by_dwelling, 0
            return [(t, -cancelled, "cancel")]
        return []

    def finish(self, end: int) -> list[tuple]:
        return []


STATE = {ExitDesk: [f for f in ExitDesk.__dataclass_fields__ if f not in ("least", "confirm", "rearm", "grace", "hold", "settle", "swap_least", "swap_window")], Till: ["taken", "paid", "by_dwelling", "since", "last"]}


def saved(machine) -> dict:
    """What changes of a machine, as plain values."""
    every = asdict(machine)
    return {k: every[k] for k in STATE[type(machine)]}


def restored(kind, state: dict | None, **params):
    machine = kind(**params)
    for k, v in (state or {}).items():
        setattr(machine, k, v)
    return machine


#: Columns of rows: where the feet are (all null in rows that only change the ledger), and changes of the ledger.
EXIT_COLUMNS = ["at_exit", "outside", "inside", "look", "edge", "taken", "paid"]
DWELL_COLUMNS = ["checkout", "overlap", "taken", "paid"]


def desk_step(desk: ExitDesk, t: int, at_exit, outside, inside, look, edge, taken, paid, checked: bool = False) -> list[tuple]:
    """A row: first its change of the ledger, then its sighting."""
    out = desk.ledger(t, taken or 0, paid or 0)
    return out if at_exit is None else out + desk.sighting(t, at_exit, bool(outside), inside, look, bool(edge), checked)


def till_step(till: Till, t: int, checkout, overlap, taken, paid) -> list[tuple]:
    out = till.ledger(t, taken or 0, paid or 0)
    return out if checkout is None else out + till.sighting(t, checkout, overlap or 0.0)


def exit_events(rows: DataFrame, person: str, time: str, tie: str, end: int | None = None, checked: bool = False, **params) -> DataFrame:
    """Warnings, verdicts and retractions of every person, from rows with EXIT_COLUMNS. end: when the recording ends, if it does.

    checked: likenesses are measured at all, so a verdict without one says so.
    """

    def close(desk):
        return [] if end is None else desk.finish(end)

    return stepped(rows.select(person, time, tie, *EXIT_COLUMNS), [person], [time, tie], lambda: ExitDesk(**params), lambda desk, t, _, *x: desk_step(desk, t, *x, checked=checked), close, EXIT_EVENTS)


def dwell_events(rows: DataFrame, person: str, time: str, tie: str, **params) -> DataFrame:
    """Payments by dwelling and their cancellations, from rows with DWELL_COLUMNS."""
    return stepped(rows.select(person, time, tie, *DWELL_COLUMNS), [person], [time, tie], lambda: Till(**params), lambda till, t, _, *x: till_step(till, t, *x), lambda till: [], DWELL_EVENTS)
