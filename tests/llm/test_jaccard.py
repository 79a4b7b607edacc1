import random

import pytest

from storeflow.llm.jaccard import near_duplicates, one_per_group

from .brute import jaccard_components


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, near_duplicates(df, **kw).collect()))


def family(rng, n, base_words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for n, words, edits in ((40, 60, 2), (30, 120, 5), (25, 12, 1), (20, 300, 12), (60, 200, 4)):
        texts += family(rng, n, words, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(40))) for _ in range(40)]
    texts += [texts[0]] * 5 + ["", None, "one two", "One  TWO", "one two three", "  \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = sorted(jaccard_components(rows))
    assert found(spark, rows, range_bytes=20_000) == want
    assert found(spark, rows, range_bytes=20_000, frequent_least=10) == want  # with frequent shingles apart


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None), (4, "")]) == [(3, 0, 3), (4, 0, 4)]
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f"), (5, "long " * 30_000)]
    assert found(spark, rows) == [(5, 1, 5), (7, 2, 7), (7, 2, 7), (9, 2, 7)]


def test_one_per_group_keeps_columns_and_clean_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "x", 0), (1, "a b c d e f g", "x", 0), (2, "A b c d e f g", "y", 1), (3, None, "z", 2), (4, "n", "z", 3)], "doc_id long, text string, label string, n int")
    got = one_per_group(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_long_lists_skip_blocks_without_losing_pairs(monkeypatch):
    import numpy as np

    from storeflow.llm import jaccard

    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 6, 400))
    n = rng.integers(5, 40, 400)
    order = np.lexsort((n, h))
    n = n[order]
    own = rng.integers(0, 3, 400)
    place = own + rng.integers(0, 4, 400)
    cols = [h, rng.permutation(400), n, own, place, rng.integers(0, 5, 400)]
    pairs = lambda: {tuple(p) for b in jaccard._pairs(cols, 80) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    short = pairs()
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert short and pairs() == short


def test_slices_without_and_with_one_of_a_frequent_shingle(spark):
    """A passage held once a slice, by one set of it, and slices that hold no frequent shingle."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(8))
    long = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    pad = "z" * 100_000
    texts = [f"{passage} {long(3)}" for _ in range(40)] + [long(30) for _ in range(40)] + [f"{passage} {long(2)}"] * 9
    rows = [(i, t if i % 3 else t + " " + pad) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want = sorted(jaccard_components(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for least in (1, 10):
        assert sorted(map(tuple, near_duplicates(df, range_bytes=100_000, frequent_least=least).collect())) == want


def test_summary_keeps_every_heavy_entry():
    import numpy as np

    from storeflow.llm.jaccard import summed

    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(np.arange(5), 300), rng.integers(100, 10**6, 5000)])
    rng.shuffle(x)
    h, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(x, 20):
        h, c = summed(h, c, *np.unique(part, return_counts=True), 40)
    assert len(h) <= 40
    for k in range(5):
        assert 300 - len(x) / 40 <= c[h == k].sum() <= 300
