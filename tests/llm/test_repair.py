import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from storeflow.llm import repair
from storeflow.llm.repair import ASSISTANT, ENDS, NOTHING, SYSTEM, USER, Costs, apply, chain, search, solve, ways


def plain_repair(rows, costs=Costs()):
    """(cost, audit, repaired) over every sequence of edits, by increasing cost; rows of (role, text, fault)."""
    best = None
    n = len(rows)

    def walk(i, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == n:
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, list(out))
        else:
            role, text, fault = rows[i]
            walk(i + 1, cost + costs.delete, audit + "D", out, inserts)
            if fault != "gone":
                extra = costs.truncated * (fault == "cut")
                walk(i + 1, cost + extra, audit + "K", [*out, (role, text)], inserts)
                for to in ("user", "assistant"):
                    walk(i + 1, cost + extra + costs.rerole, audit + "R", [*out, (to, text)], inserts)
        if inserts:
            for to in ("user", "assistant"):
                walk(i, cost + costs.insert, audit + "I", [*out, (to, "")], inserts - 1)

    walk(0, 0, "", [], n + 2)
    return best


CODE = {"s": 0, "u": 1, "a": 2}
FAULT = {"": 0, "cut": 1, "gone": 2}


def test_search_is_exhaustive():
    rng = random.Random(5)
    for trial in range(150):
        costs = rng.choice([Costs(), Costs(rerole=4, delete=3, insert=1, truncated=2), Costs(rerole=2, delete=7, insert=2, truncated=1)])
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}.", rng.choice(["", "", "", "cut", "gone"])) for i in range(rng.randrange(0, 5))]
        codes = bytes(3 * CODE.get(r[0], 3) + FAULT[f] for r, _, f in rows)
        want = plain_repair(rows, costs)
        cost, audit = search(codes, NOTHING, ENDS, costs)
        assert (cost, audit) == want[:2], (rows, costs)
        made, _ = apply(audit, NOTHING, [r for r, *_ in rows], [t for _, t, _ in rows])
        assert [(x["role"], x["text"]) for x in made] == want[2]
        cuts = sorted(rng.sample(range(len(codes) + 1), min(2, len(codes))))
        parts = [codes[a:b] for a, b in itertools.pairwise([0, *cuts, len(codes)])]
        assert chain([ways(p, costs) for p in parts]) == (cost, audit)


def test_search_stays_small():
    rng = random.Random(2)
    for _ in range(20):
        opened = []
        search(bytes(rng.choice([0, 3, 6, 3, 6, 4, 7, 5, 9, 1]) for _ in range(300)), NOTHING, ENDS, Costs(), opened)
        assert opened[0] < 30_000
    assert solve(b"", Costs()) == (0, "")
    assert {NOTHING, SYSTEM, USER, ASSISTANT} == set(range(4))


def plain_query(rows):
    """The whole contract over (conv_id, turn, role, text)."""
    out, by = {}, {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        by[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    for c, found in by.items():
        found.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        turns = [t for t, *_ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, items, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, r, x in found:
            kept = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not kept else "duplicate" if (r, x) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((r, x))
            if fault:
                n[fault] += 1
            items.append((r, x, {"blank": "gone", "duplicate": "gone", "truncated": "cut"}.get(fault, "")))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
        cost, audit, made = plain_repair(items) if len(items) < 8 else (*search(bytes(3 * CODE.get(r[:1], 3) + FAULT[f] for r, _, f in items), NOTHING, ENDS, Costs()), None)
        if made is None:
            made = [(m["role"], m["text"]) for m in apply(audit, NOTHING, [i[0] for i in items], [i[1] for i in items])[0]]
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest())
    return out


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(80):
        for t in range(rng.choice([1, 2, 3, 4, 6, 7])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            role = "system" if t == 0 and rng.random() < 0.3 else rng.choice([None, "tool"]) if rng.random() < 0.05 else role
            text = rng.choice([None, "", " \n", "same.", "no end", "é!\n ", f"text {rng.random()}.", "x" * 3000 + "?"])
            rows.append((c, None if rng.random() < 0.04 else t * rng.choice([1, 1, 2]), role, text))
    rows += [(500, t, ["user", "assistant"][t % 2] if t % 11 else "user", f"turn {t % 37}{'.' if t % 5 else ''}") for t in range(900)]
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (501, None, None, None), (502, 3, "user", "only."), (502, 3, "user", "only.")]
    return rows


def run_query(spark, tmp_path, rows, monkeypatch=None, **limits):
    from storeflow.llm import q_repair

    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as k", "'p' as piece", "2 as audit").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    if limits:
        monkeypatch.setattr(q_repair, "repair", lambda rows: repair.repair(rows, **limits))
    got = q_repair.op13_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_whole_query(spark, tmp_path, monkeypatch):
    rows = conversations()
    want = plain_query(rows)
    assert run_query(spark, tmp_path, rows) == want
    assert run_query(spark, tmp_path, rows, monkeypatch, piece_rows=3) == want  # every conversation in pieces


def test_empty_and_dropped(spark, tmp_path):
    assert run_query(spark, tmp_path, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = run_query(spark, tmp_path, [(dropped, 0, "user", "gone.")])
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_damage_kinds(spark):
    rows = [(c, 0, "assistant", "a. b! c?") for c in range(200)]
    got = {}
    for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "role", "text").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for c in range(200):
        k = zlib.crc32(f"{c}:0".encode()) % 20
        want = {0: None, 1: [("assistant", "")], 2: [("assistant", "a b c")], 3: [("assistant", "a. b! c?")] * 2, 4: [("user", "a. b! c?")]}.get(k, [("assistant", "a. b! c?")])
        assert got.get(c) == want, (c, k)
    assert F is not None
