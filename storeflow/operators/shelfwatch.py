"""What stands on a shelf, and what visits change: a machine over frames of item boxes, one small state a shelf.

While somebody is in front nothing is compared. Afterwards the items on which most of the last frames agree are matched
with what is known; a difference must hold for a while before it counts, and must not be explained by the same item having
been seen faintly in the same place.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import stepped
from .shelf import match_slots

VISITS = "start_ms long, end_ms long, people array<long>, removed array<string>, added array<string>"
#: A faint box is the same item if it covers this much of it (IoU) and has this part of its score. Fixed values.
SAME_PLACE, SAME_SCORE = 0.5, 0.5


class Items(NamedTuple):
    """Boxes (n by 4), names and scores of one frame, or of a map."""

    box: np.ndarray
    label: list
    score: np.ndarray

    @classmethod
    def of(cls, rows) -> Items:
        rows = list(rows)
        return cls(np.array([r[1:5] for r in rows], float).reshape(-1, 4), [r[0] for r in rows], np.array([r[5] for r in rows], float))

    def pick(self, which) -> Items:
        which = np.asarray(which, int)
        return Items(self.box[which], [self.label[i] for i in which], self.score[which])

    def plus(self, other: Items) -> Items:
        return Items(np.concatenate([self.box, other.box]), self.label + other.label, np.concatenate([self.score, other.score]))

    @property
    def centre(self) -> np.ndarray:
        return (self.box[:, :2] + self.box[:, 2:]) / 2

    @property
    def size(self) -> np.ndarray:
        return np.maximum(1.0, np.sqrt((self.box[:, 2:] - self.box[:, :2]).prod(1)))


def consensus(frames: list[Items], presence: float = 0.6, gate: float = 0.5, floor: float = 0.0) -> Items:
    """The items on which at least `presence` of the frames agree: median box, most frequent name (of equals the first), mean score.

    A box joins the cluster whose last member is nearest, closer than `gate` mean sizes, else begins one; boxes
    that score under `floor` are left out.
    """
    last, members = [], []
    for f in frames:
        for label, box, score in zip(f.label, f.box.tolist(), f.score.tolist(), strict=True):
            if not score >= floor:
                continue
            x, y, big = _place(box)
            k, least = len(members), gate
            for i, (u, v, size) in enumerate(last):
                apart = abs(complex(u - x, v - y)) / ((size + big) / 2)
                if apart != apart:  # not a place: of its own
                    k = len(members)
                    break
                if apart < least:
                    k, least = i, apart
            if k == len(members):
                members.append([])
                last.append(None)
            members[k].append((label, *box, score))
            last[k] = (x, y, big)
    agreed = [m for m in members if len(m) >= presence * len(frames)]
    return Items.of((Counter(x[0] for x in m).most_common(1)[0][0], *(_median(c) for c in list(zip(*m, strict=True))[1:5]), _mean([x[5] for x in m])) for m in agreed)


# A frame holds a few boxes, for which arrays cost more than they save; sums are added in the order of the array's.


def _place(box: list) -> tuple[float, float, float]:
    """Centre and size of a box."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    size = math.sqrt(area) if area >= 0 else math.nan
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, 1.0 if size < 1.0 else size


def _mean(v: list) -> float:
    if len(v) >= 8:
        return float(np.mean(v))
    total = v[0]
    for x in v[1:]:
        total += x
    return total / len(v)


def _median(v: list) -> float:
    if any(x != x for x in v):
        return math.nan
    s, h = sorted(v), len(v) // 2
    return s[h] if len(v) % 2 else (s[h - 1] + s[h]) / 2


def places(items: Items, gap: float = 0.6) -> list[str]:
    """`row.place label` of each item: rows from the top, which end where an item lies `gap` mean sizes under the row's mean; places from the left."""
    rows: list[list[int]] = []
    x, y, size = (list(c) for c in zip(*map(_place, items.box.tolist()), strict=True)) if items.label else ([], [], [])
    for i in sorted(range(len(y)), key=lambda i: (y[i] != y[i], y[i])):
        if rows and y[i] - _mean([y[k] for k in rows[-1]]) <= gap * _mean([*(size[k] for k in rows[-1]), size[i]]):
            rows[-1].append(i)
        else:
            rows.append([i])
    names = [""] * len(y)
    for r, row in enumerate(rows, 1):
        for k, i in enumerate(sorted(row, key=lambda i: x[i]), 1):
            names[i] = f"{r}.{k} {items.label[i]}"
    return names


def weakly_present(box: np.ndarray, score: float, frames: list[Items], share: float = 0.3) -> bool:
    """Whether at least `share` of the frames show the item in its place, if only faintly."""
    x1, y1, x2, y2 = map(float, box)
    own, least, hits = (x2 - x1) * (y2 - y1), SAME_SCORE * score, 0
    for f in frames:
        for (a1, b1, a2, b2), s in zip(f.box.tolist(), f.score.tolist(), strict=True):
            shared = max(min(x2, a2) - max(x1, a1), 0.0) * max(min(y2, b2) - max(y1, b1), 0.0)
            whole = own + (a2 - a1) * (b2 - b1) - shared
            if whole > 0 and shared / whole >= SAME_PLACE and s >= least:
                hits += 1
                break
    return bool(frames) and hits >= share * len(frames)


@dataclass
class ShelfWatch:
    stable: int = 1000
    window: int = 10
    presence: float = 0.6
    gate: float = 0.8
    floor: float = 0.0
    faint: float = 0.3
    known: Items | None = None
    known_at: int = 0
    known_from: list = field(default_factory=list)  # frames behind the map, faint boxes and all
    recent: deque = field(default_factory=deque)
    clear_from: int | None = None
    hidden_from: int | None = None
    people: list = field(default_factory=list)
    doubt: tuple | None = None  # a difference and since when it holds

    def frame(self, t: int, items: Items | None, blockers: list) -> list[tuple]:
        """Visits that end here: (start, end, people, removed, added). items: None where a frame was not searched."""
        if blockers:
            self.hidden_from = t if self.hidden_from is None else self.hidden_from
            self.people += [p for p in dict.fromkeys(blockers) if p not in self.people]
            self.recent.clear()
            self.clear_from = None
            return []
        self.clear_from = t if self.clear_from is None else self.clear_from
        if items is None:
            return []
        self.recent.append(items)
        while len(self.recent) > self.window:
            self.recent.popleft()
        return self._compare(t) if t - self.clear_from >= self.stable else []

    def _compare(self, t: int) -> list[tuple]:
        now = consensus(list(self.recent), self.presence, floor=self.floor)
        if self.known is None:
            self._accept(t, now)
            return []
        gone, come, now = self._differences(now)
        if not gone and not come:
            self.doubt = None
            visit = [] if self.hidden_from is None else [(self.hidden_from, t, self.people, [], [])]
            self._accept(t, now, visit=bool(visit))
            return visit
        if self.doubt is None or self.doubt[0] != (gone, come):
            self.doubt = ((gone, come), t)
        elif t - self.doubt[1] >= self.stable:
            self.doubt = None
            visit = (self.known_at if self.hidden_from is None else self.hidden_from, t, self.people, list(gone), list(come))
            self._accept(t, now, visit=True)
            return [visit]
        return []

    def _differences(self, now: Items) -> tuple[tuple, tuple, Items]:
        """Names of what left and what came, and the map with faintly seen items kept in and unannounced ones kept out."""
        slots = [[(i, *c, s, n) for i, (c, s, n) in enumerate(zip(m.centre.tolist(), m.size.tolist(), m.label, strict=True))] for m in (self.known, now)]
        pairs = match_slots(*slots, self.gate)
        lost = sorted(set(range(len(self.known.label))) - {a for a, *_ in pairs})
        found = sorted(set(range(len(now.label))) - {b for _, b, _ in pairs})
        faint = [i for i in lost if weakly_present(self.known.box[i], self.known.score[i], list(self.recent), self.faint)]
        ghost = [i for i in found if weakly_present(now.box[i], now.score[i], self.known_from, self.faint)]
        old, new = places(self.known), places(now)
        gone, come = (tuple(sorted(names[i] for i in these if i not in excused)) for names, these, excused in ((old, lost, faint), (new, found, ghost)))
        return gone, come, now.pick([i for i in range(len(now.label)) if i not in ghost]).plus(self.known.pick(faint)) if faint or ghost else now

    def _accept(self, t: int, now: Items, visit: bool = False) -> None:
        self.known, self.known_at, self.known_from = now, t, list(self.recent)
        if visit:
            self.hidden_from, self.people = None, []


def watch_shelves(frames: DataFrame, keys: list[str], time: str, tie: str, **params) -> DataFrame:
    """Visits of each shelf, changed or not, from frames with `items` (array of label, x1, y1, x2, y2, score; null: not searched) and `blockers` (ids of who hides the shelf)."""

    def step(m: ShelfWatch, t: int, _, items, blockers):
        rows = None if items is None or blockers else Items.of((i["label"], i["x1"], i["y1"], i["x2"], i["y2"], i["score"]) for i in items)
        return m.frame(t, rows, blockers or [])

    return stepped(frames.select(*keys, time, tie, "items", "blockers"), keys, [time, tie], lambda: ShelfWatch(**params), step, lambda m: [], VISITS)


def blockers_of(people: DataFrame, keys: list[str], person: str, overlap) -> DataFrame:
    """(keys, blockers) of frames: those whose box overlaps the shelf; overlap is a column of the shared part."""
    return people.where(overlap > 0).groupBy(*keys).agg(F.array_sort(F.collect_set(person)).alias("blockers"))


def weak_presence(slots: DataFrame, frames: DataFrame, keys: list[str], slot: str, frame: str, share: float = 0.3) -> DataFrame:
    """For each slot (keys, slot, x1, y1, x2, y2, score) the frames of its keys, those that show it at least faintly, and whether they are enough.

    frames: keys, frame, and the same columns of boxes. Pairs are made inside the keys, so bound these (a shelf and a window of time).
    """
    corners = ["x1", "y1", "x2", "y2", "score"]
    f = frames.select(*keys, frame, *[F.col(c).alias(f"_{c}") for c in corners])
    width = lambda a, b, p="": F.greatest(F.least(F.col(f"{b}2"), F.col(f"_{b}2")) - F.greatest(F.col(f"{a}1"), F.col(f"_{a}1")), F.lit(0))
    shared = width("x", "x") * width("y", "y")
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    hit = (shared >= SAME_PLACE * (area("") + area("_") - shared)) & (shared > 0) & (F.col("_score") >= SAME_SCORE * F.col("score"))
    n = frames.groupBy(*keys).agg(F.count_distinct(frame).alias("frames"))
    seen = slots.select(*keys, slot, *corners).join(f, keys).where(hit).groupBy(*keys, slot).agg(F.count_distinct(frame).alias("hits"))
    out = slots.select(*keys, slot).join(n, keys, "left").join(seen, [*keys, slot], "left")
    hits, total = F.coalesce("hits", F.lit(0)), F.coalesce("frames", F.lit(0))
    return out.select(*keys, slot, total.alias("frames"), hits.alias("hits"), ((total > 0) & (hits >= share * total)).alias("present"))
