"""Licence notices are found whatever else a file holds."""

import random

from storeflow.llm import licenses


def likeness(words, notice, keys, bands=1, least=0.6):
    """The best share of the notice's words that stand in order, each within `bands` slacks of one offset, in a stretch that holds a key."""
    t = notice.split()
    slack, best = len(t) // 12, 0.0
    wide = bands * slack
    for start in range(1 - len(t) - wide, len(words)):
        part = words[max(0, start) : start + len(t) + wide]
        if len(part) < least * len(t) or not any(f" {key} " in f" {' '.join(part)} " for key in keys):
            continue
        row = [0] * (wide + 1)
        for i, w in enumerate(t):
            new = []
            for j in range(wide + 1):
                p = start + i + j
                new.append(max(row[j] + (0 <= p < len(words) and words[p] == w), row[j + 1] if j < wide else 0, new[-1] if j else 0))
            row = new
        if row[-1] / len(t) >= least:
            best = max(best, row[-1] / len(t))
    return best


def bounds(words, v):
    """Likeness with offsets inside one slack, which must be found, and inside two, which may be."""
    return likeness(words, *v), likeness(words, *v, bands=2)


def test_every_notice_of_a_file(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for t, _ in licenses.TEMPLATES.values() for w in t.split()})
    notices = [t for t, _ in licenses.TEMPLATES.values()]
    worn = " ".join("x" if k % 3 == 2 else w for k, w in enumerate(licenses.TEMPLATES["bsd"][0].split()))
    texts = [" filler words ".join(notices), " ".join(notices[::-1]), "copyright c x all rights reserved " + licenses.TEMPLATES["bsd"][0], " ".join(vocabulary) + " q " + worn + " source and binary forms"]
    texts += [" z ".join(rng.sample(notices, 5)) for _ in range(10)] + [n + " " + " ".join(rng.sample(vocabulary, 60)) for n in notices]
    long = [rng.choice(vocabulary) for _ in range(20_000)]
    for k, n in enumerate(notices):
        long[1000 * (k + 1) : 1000 * (k + 1)] = n.split()
    rows = [*enumerate(texts), (999, " ".join(long))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(licenses.TEMPLATES) <= set(got[999].labels.split(","))
    for i, t in enumerate(texts):
        like = {k: bounds(t.split(), v) for k, v in licenses.TEMPLATES.items()}
        base, every = (set(filter(None, x.split(","))) for x in (got[i].base_labels, got[i].labels))
        assert base | {k for k, x in like.items() if x[0]} <= every <= base | {k for k, x in like.items() if x[1]}


def test_neighbours_change_nothing(spark):
    """A notice that ends in the next row is not in this one, and no row depends on those beside it."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    vocabulary = sorted({w for t, _ in licenses.TEMPLATES.values() for w in t.split()})
    texts = ["x released under the", "mit license is nice", "released under the", "mit license", ""]
    for t, _ in licenses.TEMPLATES.values():
        w = t.split()
        k = rng.randrange(1, len(w))
        texts += [" ".join(w[:k]), " ".join(w[k:])]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(200))) for _ in range(40)]
    ix = licenses.Index(licenses.TEMPLATES, dict.fromkeys(vocabulary, 1.0), 12, 0.6)
    plain = lambda c: c.to_pylist() if isinstance(c, pa.Array) else np.asarray(c).tolist()
    one = [[plain(c) for c in licenses.scan_texts(pa.array([t]), ix, licenses.PHRASES, 0.6)] for t in texts]
    for order in (list(range(len(texts))), rng.sample(range(len(texts)), len(texts))):
        got = licenses.scan_texts(pa.array([texts[i] for i in order]), ix, licenses.PHRASES, 0.6)
        for c, column in enumerate(got):
            assert [x for i in order for x in one[i][c]] == plain(column)
    for i, t in enumerate(texts):
        like = {k: bounds(t.split(), v) for k, v in licenses.TEMPLATES.items()}
        base, every = (set(filter(None, one[i][c][0].split(","))) for c in (4, 5))
        assert base | {k for k, x in like.items() if x[0]} <= every <= base | {k for k, x in like.items() if x[1]}
        assert max([x[0] for x in like.values()]) - 1e-9 <= one[i][6][0] <= max([*[x[1] for x in like.values()], float(one[i][1][0] > 0)]) + 1e-9


def edited(words, share, rng):
    """Words with a share of them replaced, left out, or followed by a foreign one."""
    out = []
    for w in words:
        kind = rng.choice("rdi") if rng.random() < share else ""
        out += {"r": ["foreign"], "d": [], "i": [w, "foreign"]}.get(kind, [w])
    return out


def test_recall_of_edited_notices():
    """Notices of at least 24 words with one to five percent of edits, between other words: their label, unless the edits took every key phrase."""
    import pyarrow as pa

    rng = random.Random(3)
    vocabulary = sorted({w for t, _ in licenses.TEMPLATES.values() for w in t.split()})
    ix = licenses.Index(licenses.TEMPLATES, dict.fromkeys(vocabulary, 1.0), 12, 0.6)
    tried = found = 0
    for share in (0.01, 0.03, 0.05):
        for name, (notice, keys) in licenses.TEMPLATES.items():
            if len(notice.split()) < 24:
                continue
            for _ in range(10):
                body = " ".join(edited(notice.split(), share, rng))
                if any(k in body for k in keys):
                    text = f"{' '.join(rng.sample(vocabulary, 30))} {body} {' '.join(rng.sample(vocabulary, 30))}"
                    tried += 1
                    found += name in licenses.scan_texts(pa.array([text]), ix, licenses.PHRASES, 0.6)[5][0].split(",")
    assert tried > 300 and found / tried >= 0.97, (found, tried)


def test_one_foreign_word_in_the_middle():
    import pyarrow as pa

    vocabulary = sorted({w for t, _ in licenses.TEMPLATES.values() for w in t.split()})
    ix = licenses.Index(licenses.TEMPLATES, dict.fromkeys(vocabulary, 1.0), 12, 0.6)
    for name, (notice, keys) in licenses.TEMPLATES.items():
        w = notice.split()
        body = " ".join([*w[: len(w) // 2], "foreign", *w[len(w) // 2 :]])
        if len(w) >= 12 and any(k in body for k in keys):
            assert name in licenses.scan_texts(pa.array([body]), ix, licenses.PHRASES, 0.6)[5][0].split(","), name
