"""Persons of one camera run: a machine over frames that gives every track a person, or holds it.

A frame is decided by arrays: looks of all persons lie in one block, so that a frame's boxes are compared with everybody by
one product, and who may not be chosen is a mask over that matrix. Only the picks themselves follow each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import grouped

Box = tuple[float, float, float, float]
NOBODY = -1


class Seen(NamedTuple):
    """One box of a frame. tall: high enough to be judged; cut: at the picture's edge; inside: may make its person firm."""

    track: int
    box: Box
    vec: np.ndarray | None = None
    score: float = 1.0
    tall: bool = True
    cut: bool = False
    inside: bool = True
    joints: tuple = ()


class Decision(NamedTuple):
    """person is -1 while held: `small`, `score` or `nested`. similarity and stitched tell how a new track was matched."""

    person: int = NOBODY
    new: bool = False
    similarity: float | None = None
    stitched: bool = False
    held: str | None = None


@dataclass
class Track:
    """What a track carries from frame to frame; claim: a person that it must be confirmed for, with or without credit for having been theirs."""

    person: int = NOBODY
    at: int | None = None
    box: Box | None = None
    claim: int = NOBODY
    no_credit: int = NOBODY


def shared_part(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Shared area over the smaller area, of one box with each of others."""
    sides = np.minimum(box[2:], others[:, 2:]) - np.maximum(box[:2], others[:, :2])
    shared = np.clip(sides, 0, None).prod(1)
    least = np.minimum((box[2:] - box[:2]).prod(), (others[:, 2:] - others[:, :2]).prod(1))
    return np.divide(shared, least, out=np.zeros(len(others)), where=least > 0)


def joints_apart(a: Seen, b: Seen, sure: float = 0.5) -> float | None:
    """Median distance of the joints that both show, over the narrower box; None without one."""
    width = min(x.box[2] - x.box[0] for x in (a, b))
    both = list(zip(a.joints or (), b.joints or (), strict=False))
    if not both or width <= 0:
        return None
    p, q = (np.array(x, float) for x in zip(*both, strict=True))
    sure_of = np.minimum(p[:, 2], q[:, 2]) >= sure
    return float(np.median(np.hypot(*(p - q)[sure_of, :2].T)) / width) if sure_of.any() else None


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n else v


class Crowd:
    """Everybody seen so far, column by column; person k is row k - 1. Rows of merged persons stay, and count as gone."""

    def __init__(self, looks: int):
        self.most = looks
        self.seen, self.first, self.samples = (np.zeros(0, np.int64) for _ in range(3))
        self.learned, self.firm_since = np.zeros(0), np.zeros(0)  # NaN: never, not now
        self.box, self.tentative, self.gone = np.zeros((0, 4)), np.zeros(0, bool), np.zeros(0, bool)
        self.looks, self.heights, self.kept, self.total = None, np.zeros((0, looks)), np.zeros(0, np.int64), None

    def __len__(self) -> int:
        return len(self.seen)

    def add(self, at: int, tentative: bool) -> int:
        def grown(a, value):
            return np.concatenate([a, np.full((1, *a.shape[1:]), value, a.dtype)])

        self.seen, self.first, self.samples, self.kept = grown(self.seen, at), grown(self.first, at), grown(self.samples, 0), grown(self.kept, 0)
        self.learned, self.firm_since = grown(self.learned, np.nan), grown(self.firm_since, np.nan)
        self.box, self.tentative, self.gone = grown(self.box, 0.0), grown(self.tentative, tentative), grown(self.gone, False)
        self.heights = grown(self.heights, 0.0)
        if self.looks is not None:
            self.looks, self.total = grown(self.looks, 0.0), grown(self.total, 0.0)
        return len(self)

    def see(self, p: int, b: Seen, at: int, firm_after: int) -> None:
        i = p - 1
        self.seen[i], self.box[i] = at, b.box
        if self.tentative[i]:
            begun = at if np.isnan(self.firm_since[i]) else self.firm_since[i]
            self.firm_since[i] = begun if b.tall and b.inside else np.nan
            self.tentative[i] = not self.firm_since[i] + firm_after <= at

    def look(self, i: int, vec: np.ndarray, height: float) -> None:
        """Row i gets a look; a full set gives up the one of the nearest height."""
        if self.kept[i] < self.most:
            k = self.kept[i]
            self.kept[i] += 1
        else:
            k = int(np.abs(self.heights[i] - height).argmin())
        self.looks[i, k], self.heights[i, k] = vec, height

    def learn(self, p: int, b: Seen, at: int) -> None:
        if b.vec is None:
            return
        if self.looks is None:
            self.looks, self.total = np.zeros((len(self), self.most, len(b.vec))), np.zeros((len(self), len(b.vec)))
        i = p - 1
        self.look(i, b.vec, b.box[3] - b.box[1])
        self.total[i] += b.vec
        self.samples[i] += 1
        self.learned[i] = at

    def likeness(self, vecs: np.ndarray) -> np.ndarray:
        """Person by box: the greatest product with one of the person's looks, -1 without any."""
        if self.looks is None:
            return np.full((len(self), len(vecs)), -1.0)
        each = self.looks @ vecs.T
        each[np.arange(self.most)[None, :] >= self.kept[:, None]] = -1.0
        return each.max(axis=1)

    def means(self) -> np.ndarray:
        norm = np.linalg.norm(self.total, axis=1, keepdims=True)
        return np.divide(self.total, norm, out=np.zeros_like(self.total), where=norm > 0)

    def absorb(self, into: int, other: int) -> None:
        """One person after all: sums and looks of both, where and when of the one in view."""
        i, j = into - 1, other - 1
        for vec, height in zip(self.looks[j, : self.kept[j]].copy(), self.heights[j, : self.kept[j]].copy(), strict=True):
            self.look(i, vec, height)
        self.total[i] += self.total[j]
        self.samples[i] += self.samples[j]
        self.seen[i], self.box[i], self.learned[i] = self.seen[j], self.box[j], self.learned[j]
        self.gone[j] = True


@dataclass
class Registry:
    """Continuity of persons over the tracks of one run.

    - A track keeps its person. After a gap over `recheck_ms`, or (`jump_recheck`) when it was away for a frame and comes
      back where its old box does not reach, it is judged again; a jump takes its credit for number and place.
    - A judged track takes the person most like it among those seen within `retire_ms` whom no box of the frame has:
      `match` is enough, `stitch` for someone who left close by within `stitch_ms`, or for a rechecked track's own person.
      Boxes cut by the edge match nobody. Otherwise a new person begins.
    - Held, and judged in the next frame: boxes that are small or score under `least_score`; boxes without a match that
      cover `hold_overlap` of one with a person, unless joints lie over `hold_pose` apart. A rechecked box at the edge
      keeps its person until it is whole.
    - With `one_box` a person has one box a frame: that most like the mean look, then that seen last, then the best score.
    - A new person is tentative, and no candidate, until inside and tall for `tentative_ms` without a break.
    - A person has at most `templates` looks, one every `every` ms; a full set gives up the one of the nearest height.
    - With `merge_at`, a firm person that has gathered one of these numbers of samples is compared by mean look with those who
      vanished within `retire_ms` before it was first seen (or up to `merge_overlap` ms after, if they have been
      away as long by now); the most like of at least `merge` takes it in, and is what others are compared with from then.

    Rechecks, jumps, tentative persons, one box, nested holds and merges are off by default.
    """

    match: float = 0.65
    stitch: float = 0.45
    stitch_ms: int = 3000
    stitch_bodies: float = 1.0
    retire_ms: int = 30_000
    templates: int = 5
    every: int = 500
    least_score: float = 0.0
    recheck_ms: int = 0
    jump_recheck: bool = False
    one_box: bool = False
    tentative_ms: int = 0
    hold_overlap: float = 0.0
    hold_pose: float = 0.0
    merge_at: tuple = ()
    merge: float = 0.75
    merge_overlap: int = 0
    tracks: dict[int, Track] = field(default_factory=dict)
    merges: list[tuple] = field(default_factory=list)  # (time, from, into, similarity)
    before: int | None = None  # time of the last frame

    def __post_init__(self):
        self.crowd = Crowd(self.templates)

    def frame(self, at: int, boxes: list[Seen]) -> list[Decision]:
        """Decisions in the order of the boxes."""
        if not boxes:
            self.before = at
            return []
        tracks = [self.tracks.setdefault(b.track, Track()) for b in boxes]
        was = [t.at for t in tracks]
        held = [self._arrive(t, b, at) for t, b in zip(tracks, boxes, strict=True)]
        people = np.array([NOBODY if h else t.person for t, h in zip(tracks, held, strict=True)])
        surplus = self._surplus(boxes, people, was) if self.one_box else []
        for i in surplus:
            tracks[i].person, tracks[i].claim, people[i] = NOBODY, NOBODY, NOBODY
        mine = np.flatnonzero(people != NOBODY)
        self._keep(at, boxes, people, mine)
        for i in mine:  # a merge may have given the track another person
            people[i] = tracks[i].person
        out = [Decision(int(p), held=h) for p, h in zip(people, held, strict=True)]
        fresh = [i for i in range(len(boxes)) if people[i] == NOBODY and not held[i] and i not in surplus]
        self._judge(at, boxes, tracks, out, fresh + surplus, list(mine))
        self.before = at
        return out

    def _arrive(self, t: Track, b: Seen, at: int) -> str | None:
        """Brings a track up to this frame: doubts that arise, claims that can be judged now. Why it is held, if it is."""
        if t.person != NOBODY:
            away = self.jump_recheck and t.at < self.before
            if self.recheck_ms and at - t.at > self.recheck_ms:
                t.claim = t.person
            elif away and not shared_part(np.array(b.box), np.array([t.box]))[0]:
                t.claim = t.no_credit = t.person
        t.at, t.box = at, b.box
        if t.claim == NOBODY:
            return None
        sure = b.score >= self.least_score
        if sure and b.cut and t.person != NOBODY:
            return None  # at the edge it stays who it was
        t.person = NOBODY
        return None if sure and b.tall and not b.cut else "small" if sure else "score"

    def _surplus(self, boxes: list[Seen], people: np.ndarray, was: list) -> list[int]:
        """Boxes that must leave their person to a better box of the frame."""
        mine = [i for i in range(len(boxes)) if people[i] != NOBODY]
        clear = {p: all(boxes[i].tall and boxes[i].vec is not None for i in mine if people[i] == p) and not np.isnan(self.crowd.learned[p - 1]) for p in {int(people[i]) for i in mine}}
        means = self.crowd.means() if any(clear.values()) else None
        like = {i: round(float(means[people[i] - 1] @ boxes[i].vec), 4) if clear[int(people[i])] else 0.0 for i in mine}
        ranked = sorted(mine, key=lambda i: (people[i], -like[i], -was[i], -boxes[i].score, i))
        group = {int(people[i]): i for i in reversed(mine)}  # where each person is first
        return sorted((i for before, i in zip(ranked, ranked[1:]) if people[before] == people[i]), key=lambda i: (group[int(people[i])], i))

    def _keep(self, at: int, boxes: list[Seen], people: np.ndarray, mine: np.ndarray) -> None:
        """Everybody who keeps a box is seen; who is due learns from it, and may turn out to be someone else."""
        crowd = self.crowd
        due = [i for i in mine if boxes[i].tall and not at - crowd.learned[people[i] - 1] < self.every]
        for i in mine:
            crowd.see(int(people[i]), boxes[i], at, self.tentative_ms)
        for i in due:
            crowd.learn(int(people[i]), boxes[i], at)
            if boxes[i].vec is not None and crowd.samples[people[i] - 1] in self.merge_at:
                self._merge(int(people[i]), at)

    def _merge(self, p: int, at: int) -> None:
        crowd, i = self.crowd, p - 1
        if crowd.tentative[i] or crowd.gone[i]:
            return
        free = ~crowd.gone & ~crowd.tentative & (crowd.samples > 0) & (crowd.seen < crowd.first[i] + self.merge_overlap) & (crowd.first[i] - crowd.seen <= self.retire_ms)
        if self.merge_overlap:
            free &= at - crowd.seen >= self.merge_overlap
        free[i] = False
        means = crowd.means()
        like = np.where(free, means @ means[i], -2.0)
        best = int(len(like) - 1 - like[::-1].argmax())  # of equals the last
        if like[best] < self.merge:
            return
        crowd.absorb(best + 1, p)
        self.merges.append((at, p, best + 1, float(like[best])))
        for t in self.tracks.values():
            t.person, t.claim, t.no_credit = (best + 1 if x == p else x for x in (t.person, t.claim, t.no_credit))

    def _worth(self, at: int, boxes: list[Seen], tracks: list[Track], judged: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(likeness, closeness, worth) person by judged box; worth is -inf where the person is no candidate."""
        crowd, n = self.crowd, len(judged)
        seeing = [k for k, i in enumerate(judged) if boxes[i].vec is not None and not boxes[i].cut]
        like = np.full((len(crowd), n), -1.0)
        if seeing and len(crowd):
            like[:, seeing] = crowd.likeness(np.stack([boxes[judged[k]].vec for k in seeing]))
        at_box = np.array([boxes[i].box for i in judged], float).reshape(n, 4)
        body = np.maximum(np.maximum((crowd.box[:, 3] - crowd.box[:, 1])[:, None], (at_box[:, 3] - at_box[:, 1])[None, :]), 1.0)
        feet = lambda b: ((b[:, 0] + b[:, 2]) / 2, b[:, 3])
        moved = np.hypot(*(x[:, None] - y[None, :] for x, y in zip(feet(crowd.box), feet(at_box), strict=True)))
        close = (moved <= self.stitch_bodies * body) & (at - crowd.seen <= self.stitch_ms)[:, None]
        may = np.repeat((~crowd.tentative & (at - crowd.seen <= self.retire_ms) & ~crowd.gone)[:, None], n, axis=1)
        for k, i in enumerate(judged):
            t = tracks[i]
            if t.no_credit != NOBODY:
                close[t.no_credit - 1, k] = False
            if t.claim not in (NOBODY, t.no_credit):
                close[t.claim - 1, k] = True
                may[t.claim - 1, k] = at - crowd.seen[t.claim - 1] <= self.retire_ms and not crowd.gone[t.claim - 1]
        may[:, [k for k in range(n) if k not in seeing]] = False
        return like, close, np.where(may, like + np.where(close, self.match - self.stitch, 0.0), -np.inf)

    def _judge(self, at: int, boxes: list[Seen], tracks: list[Track], out: list[Decision], judged: list[int], shown: list[int]) -> None:
        for i in judged:
            if not boxes[i].tall or boxes[i].score < self.least_score:
                out[i] = Decision(held="score" if boxes[i].tall else "small")
        judged = [i for i in judged if out[i].held is None]
        if not judged:
            return
        like, close, worth = self._worth(at, boxes, tracks, judged)
        taken = np.array([out[i].person - 1 for i in shown], int)
        worth[taken] = -np.inf
        for k, i in enumerate(judged):
            t, best = tracks[i], int(worth[:, k].argmax()) if len(worth) else NOBODY
            if best != NOBODY and worth[best, k] >= self.match:
                s = float(like[best, k])
                out[i] = Decision(best + 1, similarity=s, stitched=bool(close[best, k]) and s < self.match)
                worth[best] = -np.inf
            elif self._hidden(boxes[i], [boxes[o] for o in shown]):
                out[i] = Decision(held="nested")
                t.claim = NOBODY if t.claim == t.no_credit else t.claim
                continue
            else:
                out[i] = Decision(self.crowd.add(at, self.tentative_ms > 0), new=True)
            t.person, t.claim, t.no_credit = out[i].person, NOBODY, NOBODY
            self.crowd.see(out[i].person, boxes[i], at, self.tentative_ms)
            self.crowd.learn(out[i].person, boxes[i], at)
            shown.append(i)

    def _hidden(self, b: Seen, shown: list[Seen]) -> bool:
        """Whether a box is part of one that has a person."""
        if not self.hold_overlap or not shown:
            return False
        over = shared_part(np.array(b.box), np.array([o.box for o in shown])) >= self.hold_overlap
        for o in (o for o, x in zip(shown, over, strict=True) if x):
            apart = joints_apart(b, o) if self.hold_pose else None
            if apart is None or apart <= self.hold_pose:
                return True
        return False


def _rows(boxes: DataFrame, keys: list[str], time: str, track: str, box: str, vector: str, score=None, tall=None, cut=None, inside=None, joints=None) -> DataFrame:
    flags = {"score": (score, 1.0), "tall": (tall, True), "cut": (cut, False), "inside": (inside, True)}
    more = [(F.coalesce(F.col(c), F.lit(d)) if c else F.lit(d)).alias(f"_{n}") for n, (c, d) in flags.items()]
    points = F.transform(joints, lambda p: F.array(*[p[c].cast("double") for c in ("x", "y", "conf")])) if joints else F.lit(None).cast("array<array<double>>")
    return boxes.select(*keys, time, track, *[F.col(f"{box}.{c}").cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")], F.col(vector).alias("_vec"), *more, points.alias("_joints"))


def _play(pdf, time: str, track: str, params: dict):
    """The machine after each frame of a run: (time, boxes, decisions, machine)."""
    corners, m = ["_x1", "_y1", "_x2", "_y2"], Registry(**params)
    pdf = pdf.sort_values([time, track, *corners], kind="stable")
    named = zip(pdf[time].tolist(), pdf[track].tolist(), pdf[corners].itertuples(index=False, name=None), pdf["_vec"], *(pdf[f"_{n}"].tolist() for n in ("score", "tall", "cut", "inside")), pdf["_joints"], strict=True)
    for at, rows in groupby(named, key=lambda r: r[0]):
        seen = [Seen(k, b, None if v is None else unit(np.asarray(v, float)), *f, () if j is None else tuple(j)) for _, k, b, v, *f, j in rows]
        yield at, seen, m.frame(at, seen), m


def register(boxes: DataFrame, keys: list[str], time: str, track: str, box: str, vector: str, score: str | None = None, tall: str | None = None, cut: str | None = None, inside: str | None = None, joints: str | None = None, **params) -> DataFrame:
    """Person of every box (person_id, -1 while held) by `Registry`; a key is one camera run, rows of one time a frame.

    box: struct of x1, y1, x2, y2; vector: array or null; the other columns are optional. joints: array of (x, y, conf).
    A null score, tall or inside holds nothing against a box; equal tracks of a frame are taken in the order of their boxes.
    """

    def run(pdf):
        return [(at, s.track, *w) for at, seen, said, _ in _play(pdf, time, track, params) for s, w in zip(seen, said, strict=True)]

    return grouped(_rows(boxes, keys, time, track, box, vector, score, tall, cut, inside, joints), keys, run, f"{time} long, {track} long, person_id int, is_new boolean, similarity double, stitched boolean, held string")


def merged_people(boxes: DataFrame, keys: list[str], time: str, track: str, box: str, vector: str, merge_at: tuple = (10, 20, 40), **params) -> DataFrame:
    """Late merges of a run, in order: when, from, into, similarity. `joins.alias_roots` resolves their chains."""

    def run(pdf):
        m = None
        for *_, m in _play(pdf, time, track, {**params, "merge_at": merge_at}):
            pass
        return m.merges if m is not None else []

    flags = {n: params.pop(n) for n in ("score", "tall", "cut", "inside", "joints") if n in params}
    return grouped(_rows(boxes, keys, time, track, box, vector, **flags), keys, run, f"{time} long, from_id int, into_id int, similarity double")
