"""The pipeline's stages on a small table."""

import collections
import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{rng.randint(100, 999)}" for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(60) for _ in range(120)]
    toxic = [i % 5 == 2 for i in range(120)]
    texts = [t + (" zorkwit zorkwit" if x else "") for t, x in zip(texts, toxic, strict=True)]
    near = texts[0].split()
    near[30] = "edited"
    passage = make(30)
    more = [texts[0], " ".join(near), f"{make(40)} {passage}", f"{passage} {make(40)}", None, ""]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts + more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    seen = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in out} for name, out in seen.items()}
    clean = {i for i, x in enumerate(toxic) if not x} | set(range(120, 126))
    assert ids["toxicity"] == clean
    assert ids["exact dedup"] == clean - {0, 124}  # the largest id of equal texts stays
    assert ids["n-gram Jaccard join"] == clean - {0, 124, 121}
    assert ids["suffix-array dedup"] == ids["n-gram Jaccard join"]
    text = {r["doc_id"]: r["text"] for r in seen["suffix-array dedup"]}
    assert passage in text[122] and passage[10:-10] not in text[123]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["suffix-array dedup"])
    total = collections.Counter()
    for r in seen["packing"]:
        total[r["doc_id"]] += r["length"]
    assert set(total) == ids["suffix-array dedup"] and all(total[r["doc_id"]] == r["doc_tokens"] for r in seen["packing"])


def test_passages_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    make = lambda: " ".join(str(rng.randint(100, 999)) for _ in range(40))
    rows = [(None, make(), f"l{k}", f"s{k}", 0) for k in range(4)] + [(7, make(), f"l{k}", f"s{k}", 0) for k in range(4, 6)] + [(8, make(), None, None, 0), (9, None, "l9", "s9", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.passage_stage(spark, docs, "").collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, t or "", a, b, len(t or "")) for i, t, a, b, _ in rows), key=key)


def test_null_and_repeated_ids_in_every_stage(spark, tmp_path):
    """No row is multiplied or gets another row's columns, and only copies go."""
    rng = random.Random(8)
    make = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(100, 999)}" for _ in range(60))
    same, near = make(), make()
    texts = [(None, make()), (None, make()), (None, same), (None, None), (None, None), (5, make()), (5, make()), (5, same), (5, same), (6, same), (7, near), (7, make()), (8, near + " more"), (9, ""), (10, make())]
    rows = [(i, t, f"l{k}", f"s{k}", len(t or "")) for k, (i, t) in enumerate(texts)]
    given = {(t or "", f"l{k}", f"s{k}"): i for k, (i, t) in enumerate(texts)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(5, 1, 0), (10, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        found = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.DOCUMENT_COLUMNS
            assert all(given[r["text"] or "", r["lang"], r["source"]] == r["doc_id"] for r in found)
            counts.append(len(found))
    assert counts == [15, 10, 9, 9]  # same is one row of four, empty texts one of three; near is one row of two
    assert sum(r["length"] for r in found) == sum({(r["doc_id"], r["sequence_id"], r["offset"]): r["length"] for r in found}.values())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
