import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from storeflow.llm import katz


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_model(texts):
    """Katz by dictionaries: (unigram probability, conditional probability, counts)."""
    one, two = Counter(), Counter()
    for t in texts:
        seq = [None, *tokens(t), None]
        one.update(seq[1:])
        two.update(zip(seq, seq[1:]))
    total = sum(one.values())

    def discounts(counts):
        n = Counter(counts.values())
        d = {}
        for r in range(1, 6):
            d[r] = 1.0
            if n[1] and n[6] and n[r] and n[r + 1] and 6 * n[6] < n[1]:
                a = 6 * n[6] / n[1]
                x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
                d[r] = x if 0 < x < 1 else 1.0
        return lambda c: d.get(c, 1.0)

    d1, d2 = discounts(one), discounts(two)
    lost = sum((1 - d1(c)) * c for c in one.values())
    below = total if lost > 0 else total + 1
    p1 = lambda w: d1(one[w]) * one[w] / below if w in one else (lost or 1) / below
    follow = {}
    for (v, w), c in two.items():
        follow.setdefault(v, {})[w] = c

    def p2(w, v):
        if v not in follow:
            return p1(w)
        f = follow[v]
        n, lost_v = sum(f.values()), sum((1 - d2(c)) * c for c in f.values())
        under = n if lost_v > 0 else n + 1
        if w in f:
            return d2(f[w]) * f[w] / under
        return (lost_v or 1) / under / (1 - sum(p1(x) for x in f)) * p1(w)

    return p1, p2, one, total, follow


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["É", "é", "x" * 90]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words[: rng.choice([3, 12, 63])]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, t.upper() if i % 7 == 0 else t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "never seen words here"), (n + 4, "w1 " * 3000), (5, rows[5][1]), (None, "w1 w2")]
    return rows


def test_like_a_plain_model(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'a' as chunk", "2 as score").repartition(3)
    teaches = F.coalesce(F.col("doc_id") % 4 != 3, F.lit(True))
    p1, p2, one, total, follow = plain_model([t for i, t in rows if i is None or i % 4 != 3])
    for v in list(follow)[:20]:
        left = 1 - sum(p2(w, v) for w in one)
        assert math.isclose(left, p2("not a word", v), rel_tol=1e-6), v
    expected = []
    for i, t in rows:
        seq = [None, *tokens(t), None]
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in seq[1:])
        expected.append((-1 if i is None else i, len(seq) - 1, sum(w in one for w in seq[1:]), total, round(base, 6), round(sum(math.log10(p2(w, v)) for v, w in zip(seq, seq[1:])), 6)))
    for limits in ({}, {"tokens": 300, "entries": 200, "split": 40}, {"tokens": 300, "entries": 500, "split": 40, "hot_rows": 0}):
        got = katz.score(df, teaches, **limits).collect()
        mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
        assert len(mine) == len(rows)
        for a, b in zip(mine, sorted(expected), strict=True):
            assert a[:4] == b[:4] and math.isclose(a[4], b[4], abs_tol=1e-4) and math.isclose(a[5], b[5], abs_tol=1e-4), (a, b)


def test_discounts_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in katz.score(df, F.lit(False)).collect()}
    assert got["a"].n_tokens == 3 and got["a"].n_known == 0 and got["a"].score == 0 and got["a"].base_score == 0
    assert katz.score(df.where("false"), F.lit(True)).count() == 0
    d = katz.ratios([0, 100, 40, 20, 10, 6, 4])
    assert d[6] == 1 and all(0 < x <= 1 for x in d)
