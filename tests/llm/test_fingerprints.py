import hashlib
import random
import re

import xxhash

from pyspark.sql import functions as F

from storeflow.llm.fingerprints import fingerprint_edits, near_pairs, placed


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def simhash(text, k=3):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[\t-\r ]", text) if w]
    runs = [words[i : i + k] for i in range(max(len(words) - k, 0) + 1)] if words else []
    terms = [chain(r) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        a, e, x = simhash(text), simhash(edited), simhash(after)
        like = lambda p, q: 1 - bin(p ^ q).count("1") / 64
        near = sum(bin(a ^ simhash(t or "")).count("1") <= 3 for _, t in rows) - 1 if key is not None and key % 50 == 0 else None
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{e:016x}", like(a, e), like(a, x), near))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "'x' as rn", "true as halo")
    got = sorted(map(tuple, fingerprint_edits(df, buckets=5).collect()), key=str)
    assert got == brute(rows)


def test_like_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(60)]
    rows = [(i * 7, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    check(spark, rows + [(5, None), (6, ""), (9, "ab"), (9, "ab"), (9, "zz y"), (11, "x\ty\n\nz  w"), (1000, "long text " * 20_000), (None, "n n"), (2000, "ab"), (2050, ""), (2100, None), (2001, "ab ab")])


def test_bucket_bounds(spark):
    rng = random.Random(8)
    for n in (0, 1, 2, 7, 50):
        bounds = sorted(rng.sample(range(-200, 200), n))
        got = spark.range(-220, 220).select("id", placed(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == sum(x < r.id for x in bounds) for r in got)


def test_edges(spark):
    check(spark, [(4, "one two three four five six")])
    assert fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs_finds_all(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(30)]
    fps = set(base)
    for f in base:
        for _ in range(6):
            g = f
            for _ in range(rng.randrange(1, 6)):
                g ^= 1 << rng.randrange(63)
            fps.add(g)
    fps = sorted(fps)
    want = {(a, b, d) for i, a in enumerate(fps) for b in fps[i + 1 :] if (d := bin(a ^ b).count("1")) <= 3}
    df = spark.createDataFrame([(f,) for f in fps + fps[:5]] + [(None,)], "fingerprint long")
    for blocks in (4, 6):
        assert {tuple(r) for r in near_pairs(df, radius=3, blocks=blocks).collect()} == want
