"""Long chains of successive revisions, each alike only to its neighbours."""

import random

from storeflow.llm.jaccard import components, near_duplicates


def test_chain_of_a_thousand_documents(spark):
    rng = random.Random(5)
    n, step, width = 1000, 3, 60
    words = [f"w{i}" for i in range(n * step + width)]
    ids = rng.sample(range(10**6), n)
    rows = [(d, " ".join(words[i * step : i * step + width])) for i, d in enumerate(ids)] + [(10**7, "quite another text with some more words")]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(d, min(ids)) for d in ids} | {(10**7, 10**7)}


def test_components_of_random_paths(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10**6), 3000)
    paths = [ids[:2000], ids[2000:2500], ids[2500:2999], ids[2999:]]
    links = [p for x in paths for p in zip(x, x[1:])] + [(ids[7], ids[7]), (ids[1], ids[0])]
    got = components(spark.createDataFrame([(i,) for i in ids], "set_id long"), spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, min(x)) for x in paths for i in x)
