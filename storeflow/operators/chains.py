"""Decisions that depend on the decision before: links between views, owners of lanes, episodes of slots.

Each is a machine over a key's moments in order, which holds a state as large as one moment.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import _batch, stepped
from .matching import hungarian

LINKS = "near long, far long, score double, position double, appearance double"
LEASES = "at_ms long, kind string, device long, owner long"
EPISODES = "slot string, start_ms long, end_ms long, state string, ratio double, baseline double, changed boolean, direction string, edge_ratio double"


@dataclass
class LinkChain:
    """Who of the near view is who of the far view, window by window.

    A pair's score is `weight` of position and the rest of appearance; without a position there is no pair, without an
    appearance position alone counts. Where a near person has only one far candidate, an appearance of `solo` lifts the
    score to `least`. The pair of the window before gets `keep` more (`recent`: only if it was made in the very window
    before). The windows' best total decides, and pairs under `least` are dropped.
    """

    weight: float = 0.7
    least: float = 0.5
    keep: float = 0.1
    solo: float = 0.85
    recent: bool = False
    partner: dict = field(default_factory=dict)  # near: far
    made_in: dict = field(default_factory=dict)  # near: window

    def window(self, n: int, pairs: list[tuple]) -> list[tuple]:
        """pairs: (near, far, position, appearance), None where unknown. Links of this window."""
        near, far = (sorted({p[i] for p in pairs}) for i in (0, 1))
        score, parts = np.full((len(near), len(far)), -1.0), {}
        rivals = {a: sum(p[0] == a and p[2] is not None for p in pairs) for a in near}
        for a, b, position, appearance in pairs:
            if position is None:
                continue
            s = position if appearance is None else self.weight * position + (1 - self.weight) * appearance
            if self.solo > 0 and rivals[a] == 1 and appearance is not None and appearance >= self.solo:
                s = max(s, self.least)
            if self.partner.get(a) == b and (not self.recent or n - self.made_in[a] <= 1):
                s += self.keep
            score[near.index(a), far.index(b)] = s
            parts[a, b] = position, appearance
        links = [(near[i], far[j], float(score[i, j]), *parts[near[i], far[j]]) for i, j in hungarian(score) if score[i, j] >= self.least]
        linked = {a: b for a, b, *_ in links}
        for a in near:
            if a in linked:
                self.partner[a], self.made_in[a] = linked[a], n
            else:
                self.partner.pop(a, None)
        return links


def link_windows(pairs: DataFrame, keys: list[str], window: str, near: str, far: str, position: str, appearance: str, **params) -> DataFrame:
    """Links of each window (a whole number, one after the other) from scored pairs of the persons in view."""
    pair = F.struct(F.col(near).cast("long"), F.col(far).cast("long"), F.col(position).cast("double"), F.col(appearance).cast("double"))
    moments = pairs.groupBy(*keys, window).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def step(m: LinkChain, n: int, rows: list[dict]) -> list[tuple]:
        return [(n, *x) for x in m.window(n, [tuple(r.values()) for r in rows])]

    return stepped(moments, keys, [window], lambda: LinkChain(**params), step, lambda m: [], f"{window} long, {LINKS}")


@dataclass
class Lease:
    """One lane's owner: the first device that measures it. Another one that measures is a conflict, reported once a device, until
    the owner has been silent for more than `stale` ms; then it takes over."""

    stale: int = 3000
    owner: int | None = None
    heard: dict = field(default_factory=dict)
    conflicts: list = field(default_factory=list)

    def message(self, t: int, device: int, measures: bool) -> list[tuple]:
        """What is reported, and (`kind` ADMITTED) whether a measurement counts."""
        out = []
        if measures and self.owner != device:
            if self.owner is not None and t - self.heard[self.owner] <= self.stale:
                if device not in self.conflicts:
                    self.conflicts.append(device)
                    out.append((t, "LANE_CONFLICT", device, self.owner))
            else:
                if self.owner is not None:
                    out.append((t, "LANE_OWNER_CHANGED", device, self.owner))
                self.owner = device
        self.heard[device] = t
        return out + [(t, "ADMITTED", device, self.owner)] * (measures and self.owner == device)


def lane_leases(messages: DataFrame, lane: str, device: str, time: str, tie: str, measures: str, stale: int) -> DataFrame:
    """Reports and admitted measurements of every lane; a device's other messages keep its lease alive on all lanes that it measures."""
    at = messages.where(F.col(measures)).select(F.col(lane).alias("_lane"), F.col(device).alias("_device")).distinct()
    alive = messages.join(at, F.col(device) == F.col("_device")).select(F.col("_lane").alias(lane), time, tie, device, (F.col(measures) & (F.col(lane) == F.col("_lane"))).alias("measures"))
    return stepped(alive.select(lane, time, tie, device, "measures"), [lane], [time, tie], lambda: Lease(stale), lambda m, t, _, who, counts: m.message(t, who, bool(counts)), lambda m: [], LEASES)


def changed_part(a: np.ndarray, b: np.ndarray, level: float = 0.6) -> float:
    """Share of the places where two looks differ by over `level` spreads, each look taken about its mean."""
    a, b = ((x - x.mean()) / (x.std() + 1e-6) for x in (a, b))
    return float((np.abs(a - b) > level).mean())


def changed_parts(a: list[np.ndarray], b: list[np.ndarray], level: float) -> list[float]:
    """changed_part of each pair, at once where all looks are as long."""
    if len({len(x) for x in a}) > 1:
        return [changed_part(x, y, level) for x, y in zip(a, b, strict=True)]
    x, n = np.array(a + b), len(a[0])
    x -= np.add.reduce(x, 1, keepdims=True) / n
    x /= np.sqrt(np.add.reduce(x * x, 1, keepdims=True) / n) + 1e-6
    return (np.add.reduce(np.abs(x[: len(a)] - x[len(a) :]) > level, 1) / n).tolist()


@dataclass
class Slot:
    reference: np.ndarray | None = None
    edges: float = 0.0
    clear_from: int | None = None
    hidden_from: int | None = None


@dataclass
class SlotEpisodes:
    """Hidden stretches of a shelf's slots, and what changed behind them.

    A slot is compared `stable` ms after it is seen again, with the look it had before. It changed if at least `part` of it differs, and
    `margin` more than the median of the other slots, which differ as much when only the light did. Fewer edges than
    before (`drop`) mean fewer items, more (`rise`) mean more; a look of the empty slot decides instead where there is one.
    """

    stable: int = 600
    level: float = 0.6
    part: float = 0.08
    margin: float = 0.05
    drop: float = 0.85
    rise: float = 1.15
    empty: dict = field(default_factory=dict)
    slots: dict = field(default_factory=dict)

    def moment(self, t: int, shown: list[tuple]) -> list[tuple]:
        """shown: (slot, hidden, look, edges) of one frame. Episodes that end here."""
        out, again, looks = [], [], {}
        for name, hidden, look, edges in shown:
            s = self.slots.get(name)
            if s is None:
                s = self.slots[name] = Slot()
            look = np.asarray(look, float)
            if s.reference is not None and len(s.reference) == len(look):
                looks[name] = look
            if hidden:
                s.hidden_from, s.clear_from = t if s.hidden_from is None else s.hidden_from, None
                continue
            s.clear_from = t if s.clear_from is None else s.clear_from
            if t - s.clear_from < self.stable:
                continue
            if s.reference is not None and s.hidden_from is not None:
                again.append((name, s, look, edges))
                continue
            if s.hidden_from is not None:
                out.append((name, s.hidden_from, t, "no_reference", None, None, False, None, None))
            s.reference, s.edges, s.hidden_from = look, edges, None
            looks.pop(name, None)
        if not again:
            return out
        differ = dict(zip(looks, changed_parts([self.slots[n].reference for n in looks], list(looks.values()), self.level), strict=True)) if looks else {}
        renewed = [n for n in dict.fromkeys(x for x, *_ in shown) if n not in differ]  # this very moment, if they have a reference
        for name, s, look, edges in again:
            ratio = differ[name] if name in differ else 1.0
            rest = [v for n, v in differ.items() if n != name]
            rest += [0.0 for n in renewed if n != name and self.slots[n].reference is not None]
            baseline = float(median(rest)) if rest else 0.0
            changed = ratio >= self.part and ratio - baseline >= self.margin
            by_edges = edges / max(s.edges, 1e-6)
            out.append((name, s.hidden_from, t, "compared", ratio, baseline, changed, self._direction(name, s, look, by_edges) if changed else None, by_edges if changed else None))
            s.reference, s.edges, s.hidden_from = look, edges, None
        return out

    def _direction(self, name: str, s: Slot, look: np.ndarray, by_edges: float) -> str:
        bare = self.empty.get(name)
        if bare is not None and len(bare) == len(look):
            return "DECREASED" if changed_part(bare, look, self.level) < changed_part(bare, s.reference, self.level) else "INCREASED"
        return "DECREASED" if by_edges <= self.drop else "INCREASED" if by_edges >= self.rise else "CHANGED"

    def finish(self, t: int) -> list[tuple]:
        return [(n, s.hidden_from, t, "unfinished", None, None, False, None, None) for n, s in self.slots.items() if s.hidden_from is not None]


def slot_episodes(frames: DataFrame, keys: list[str], time: str, shown: Column, end: int, **params) -> DataFrame:
    """Episodes of every shelf from frames (keys, time, and what `shown` needs); end: when the recording ends.

    shown: the frame's array of (slot, hidden, look: array of numbers, edges). It is worked out after frames are dealt and
    sorted, so that looks are neither shuffled nor sorted. Frames of one moment are taken together.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([frames.schema[k] for k in keys] + T._parse_datatype_string(EPISODES).fields)
    arrow = to_arrow_schema(out)
    order = lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2].tolist(), r[3]))

    def run(batches):
        head, machine, held = None, None, []  # held: what the frames of one moment show

        def moment():
            return [head[:-1] + tuple(r) for r in machine.moment(head[-1], held[0] if len(held) == 1 else sorted((r for rows in held for r in rows), key=order))]

        for batch in batches:
            made = []
            lists = batch.column("_shown")
            slots, begin = lists.values, lists.offsets.to_pylist()
            looks = slots.field(2)
            values, cuts = looks.values.to_numpy(zero_copy_only=False), looks.offsets.to_pylist()
            rows = list(zip(slots.field(0).to_pylist(), slots.field(1).to_pylist(), [values[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], slots.field(3).to_pylist(), strict=True))
            for k, at in enumerate(zip(*(batch.column(c).to_pylist() for c in [*keys, time]), strict=True)):
                if at != head:
                    if held:
                        made += moment()
                    if head is None or at[:-1] != head[:-1]:
                        made += [head[:-1] + tuple(r) for r in machine.finish(end)] if machine else []
                        machine = SlotEpisodes(**params)
                    head, held = at, []
                held.append(rows[begin[k] : begin[k + 1]])
            yield _batch(made, arrow)
        if held:
            yield _batch(moment() + [head[:-1] + tuple(r) for r in machine.finish(end)], arrow)

    dealt = frames.repartition(*keys).sortWithinPartitions(*keys, time)
    return dealt.select(*keys, time, F.sort_array(shown).alias("_shown")).mapInArrow(run, out)
