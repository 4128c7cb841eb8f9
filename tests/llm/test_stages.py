"""The deduplicating stages row by row: repeated rows, repeated and null ids; run() against brute force."""

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(at, n=40):
    return " ".join(f"w{(at * 7919 + i * 104729) % 99991}" for i in range(n))


def test_rows_with_equal_and_null_ids(spark):
    a, b, c, d, e = (words(i) for i in range(1, 6))
    rows = [(1, a, "en", "s", 1)] * 3 + [(1, a, "de", "s", 1), (0, a, "en", "s", 1)]
    rows += [(None, b, "en", "s", 1)] * 4 + [(None, c, "en", "s", 1), (None, c, None, "s", 1), (6, c, "en", "s", 1), (6, c, "en", "s", 1)]
    rows += [(1, d, "en", "s", 1), (None, e, "en", "s", 1), (8, None, "en", "s", 1), (None, "", "en", "s", 1), (8, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = P.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = {(1, a), (None, b), (6, c), (1, d), (None, e), (8, "")}
    out = [(r.doc_id, r.text or "") for r in got.collect()]
    assert len(out) == 6 and set(out) == want

    near = P.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns
    out = [(r.doc_id, r.text or "") for r in near.collect()]
    assert len(out) == 6 and set(out) == want - {(1, a)} | {(0, a)}
    assert P.drop_copies(spark, docs.limit(0), "").count() == P.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """Without labels nothing is toxic; the other stages one after the other in plain Python.  Near copies must go."""
    import hashlib

    from test_simhash import components, plain
    from tokenizers import Tokenizer

    from strandframe.llm.queries import tokenizer_file

    item = words(900, 12)
    texts = {i: words(i, 60) for i in range(20)}
    texts |= {100 + i: words(i, 60) for i in range(0, 20, 5)}  # exact copies
    texts |= {200 + i: words(200 + i, 900) for i in range(12)} | {300 + i: words(200 + i, 900) + " tail" for i in range(12)}  # near copies
    texts |= {400: words(400) + " " + item, 401: None, 402: ""}
    rows = [(i, t, "en", "s", 1) for i, t in texts.items()] + [(3, texts[3], "en", "s", 1), (None, words(77, 60), "en", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    low = lambda i: -1 if i is None else i
    last = {}
    for i, t, *_ in rows:
        last[t or ""] = max((i, last.get(t or "", i)), key=low)
    comp = components({plain(t) for t in last})
    first = {}
    for t, i in last.items():
        c = comp[plain(t)]
        first[c] = min(first.get(c, (i is None, i, t)), (i is None, i, t))
    near = set(last.values()) - {i for _, i, _ in first.values()}
    assert near & set(range(300, 312)) and near <= set(range(300, 312))
    reader = Tokenizer.from_file(tokenizer_file())
    want = []
    for _, i, t in first.values():
        if item not in t:
            ids = reader.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_clashing_names_and_maps(spark):
    """Columns called like the stages' own ones, and maps, in rows that repeat."""
    from strandframe.llm import decontaminate, exact_dedup, simhash

    text = "one two three four five six seven"
    rows = [(1, text, 1, "x", True, {"b": 1}), (1, text, 1, "x", True, {"a": 1}), (None, text, 2, "y", False, None), (None, "other words here", 3, "z", False, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _SHA string, _repeated boolean, _row map<string,int>")
    kept = exact_dedup.distinct_texts(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r._id, r._row) for r in kept.collect()) == [(0, 3, {}), (1, 1, {"a": 1})]
    assert sorted((r.doc_id or 0, r._id) for r in simhash.representatives(docs).collect()) == [(0, 3), (1, 1)]
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert sorted(r._id for r in decontaminate.clean(docs, items).collect()) == [1, 1, 2]
