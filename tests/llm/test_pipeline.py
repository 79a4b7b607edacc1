import random

import corpus_pipeline
from storeflow.llm import decontaminate


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, text(40) + (" idiot scum clown" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    item = text(30)
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[1][1] + " tail", "en", "s", 0), (1002, text(10) + " " + item, "en", "s", 0), (1003, None, "en", None, 0), (1004, "", None, "s", 0), (1004, "", None, "s", 0), (1005, "w1 " * 20_000, "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{d}/out-{name}")
        docs = spark.read.parquet(f"{d}/out-{name}")
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    toxic = {i for i in range(400) if i % 4 == 0}
    assert not toxic & set(seen[0]) and set(seen[0]) == {r[0] for r in rows} - toxic
    assert set(seen[0]) - set(seen[1]) == {1000, 1001} and seen[1].count(1004) == 1
    assert set(seen[1]) - set(seen[2]) == {1002}
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen[2])
    assert decontaminate.drop_contaminated(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count() == len(seen[2])


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for n, s in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], s).write.parquet(f"{d}/{n}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
