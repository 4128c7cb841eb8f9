"""The pipeline's stages: planted cases go, clean documents stay, columns are kept."""

import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    fresh = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    item = fresh(12)
    clean = {i: fresh(80) for i in range(200)}
    toxic = {i: fresh(40) + " scumword trashword " + fresh(40) for i in range(200, 260)}
    long = fresh(400)
    rows = [(i, t, "en", "s", len(t)) for i, t in (clean | toxic).items()]
    rows += [(300, clean[0], "en", "s", 1), (301, long, "en", "s", 1), (302, long + " tail", "en", "s", 1), (303, "a " + item + " b", "en", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id for r in P.run(spark, folder).collect()}
    near = {301, 302}
    assert not got & set(toxic) and 303 not in got
    assert got - near == set(clean) - {0} | {300}
    assert 301 in got
    assert P.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == ["doc_id", "text", "lang", "source", "n_chars"]
