"""Scans, parsers, filter, samples and whole plans on small files."""

import csv
import random

import pytest
from article_lines import read_article
from pyspark.sql import functions as F

from corpusloom.operators import articles, boilerplate, excerpts, sampling, testsets
from corpusloom.operators.articles import general_paragraphs, specific_paragraphs, split_lines
from corpusloom.plans import evaluation, learning
from corpusloom.plans.corpus import DataExtractor, FineTuningDataExtractor
from corpusloom.sources import tables
from corpusloom.sources.articles import read_pages

GENERAL = """intro
==== Goal 1: No poverty ====
First text of the goal about poverty and people.

== Level two stays ==
=== Closing ===
not read
==== Goal 2: No hunger ====
Second text {{template {{inner}}}} with [[link|label]].
"""
SPECIFIC = """Lead text<ref>r</ref> of the article.
A list follows:
* one
* two
after the list
== Background ==
Body of the background, with '''bold''' words.
=== Sub ===
more body
== Tools ==
tool text
=== Target 1.2: Reduce it by half ===
The target body.
Items:
* a
* b
=== Target 1.a. Other target ===
other body
== See also ==
nothing
"""


def xml(path, pages):
    body = "".join(f"<page><title>{t}</title><revision><id>1</id><timestamp>2020-01-01T00:00:00Z</timestamp><text xml:space=\"preserve\">{x.replace('&', '&amp;').replace('<', '&lt;')}</text></revision><revision><id>2</id><text>later</text></revision></page>" for t, x in pages)
    path.write_text(f'<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">{body}</mediawiki>', encoding="utf-8")
    return str(path)


@pytest.fixture
def files(tmp_path):
    return [xml(tmp_path / "general.xml", [("Goals", GENERAL)]), xml(tmp_path / "specific.xml", [("Sustainable Development Goal 1", SPECIFIC), ("Sustainable Development Goal 2", SPECIFIC.replace("1.", "2."))])]


def test_scan(spark, files):
    pages = read_pages(spark, files, [True, False])
    rows = pages.orderBy("file_ord", "page_ord").collect()
    assert [(r["is_general"], r["title"], r["revision_id"], r["revision_timestamp"]) for r in rows] == [(True, "Goals", "1", "2020-01-01T00:00:00Z"), (False, "Sustainable Development Goal 1", "1", "2020-01-01T00:00:00Z"), (False, "Sustainable Development Goal 2", "1", "2020-01-01T00:00:00Z")]
    assert rows[0]["text"] == GENERAL.strip()  # the reader trims values
    with pytest.raises(ValueError):
        read_pages(spark, files, [True])


def test_split_lines(spark):
    texts = ["a\nb\r\nc\rd\x0be\x85f\u2028g\x1ch\n", "", "\n", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(split_lines(F.col("t"))).collect()] == [t.splitlines() for t in texts]


def test_general_article(spark, files):
    pages = read_pages(spark, files, [True, False]).filter("is_general")
    rows = general_paragraphs(pages).orderBy("emit_ord").collect()
    assert [(r["goal"], r["text"]) for r in rows] == [("1", "First text of the goal about poverty and people."), ("1", "== Level two stays =="), ("2", "Second text {{template {{inner}}}} with [[link|label]].")]
    assert rows[0]["source_url"] == "https://en.wikipedia.org/wiki/Goals" and rows[0]["section"] == "General"


def test_parsers():
    lead = [x for x in read_article("a:\n* b\n* c\n= h\nno") if x[1] == "Lead section"]
    assert lead == [("", "Lead section", "a: b;;  c;; "), ("", "Lead section", "= h")]
    assert list(read_article("a:\n* b")) == []  # a list still open at the end is lost
    named = [x for x in read_article("= x\n== Tools of trade ==\nx *\ny *\nz\n=== Custodian agencies\nq\n")]
    assert named == [("", "Tools of trade", "x ;; y ;; "), ("", "Tools of trade", "z")]
    deferred = [x for x in read_article("= x\n== Tools ==\nlist:\nq *\n== Next ==\nbody\nmore\n")]
    assert deferred == [("", "Tools", "list:q ;; "), ("", "Tools", "body")]
    both = [x[1] for x in read_article("= x\n== Background and tools ==\nt\n")]
    assert both == ["Background and tools", "Background and tools"]
    targets = list(read_article("= x\n=== Target 1.2: By 2030 ===\nt\nl:\n* i\n=== Targets 1.a. Do ===\nu\n=== Other ===\nv\n"))
    assert targets == [("1.2", "Targets", "By 2030"), ("1.2", "Targets", "t"), ("1.2", "Targets", "l: i;; "), ("1.a", "Targets", "Do"), ("1.a", "Targets", "u")]
    with pytest.raises(ValueError):
        list(read_article("= x\n=== Target without a mark\n"))


def test_specific_article(spark, files):
    pages = read_pages(spark, files, [True, False]).filter("not is_general and title like '%1'")
    rows = specific_paragraphs(pages).orderBy("emit_ord").collect()
    assert {r["goal"] for r in rows} == {"1"}
    assert [r["target"] for r in rows if r["section"] == "Targets"] == ["1.2", "1.2", "1.2", "1.a", "1.a"]


ARTICLE_LINES = [
    "plain text", "* first", "* second :", "last *", "a list:", "both * of:", "*", ":", "= top", "== Background ==", "== Tools and background ==", "==\ttools", "== Next one ==", "==Xy", "=== Sub ===", "=== Custodian agencies ===",
    "=== Target 1.2: By 2030 ===", "===targets 1.a. Do it", "=== Target 1.B: ", "=== Other ===", "== See also ==", "  padded\u00a0", "", "Links with other SDGs", "== links with other SDGs", "==== deep",
]


def test_windows_read_what_the_lines_say(spark):
    """Random articles: every order of lists, headings, sections that end in an open list, and targets."""
    rng = random.Random(12)
    texts = ["\n".join(rng.choices(ARTICLE_LINES, k=rng.randint(0, 25))) for _ in range(1500)] + [None, "", "\n\n"]
    pages = spark.createDataFrame([(0, i, "Sustainable Development Goal 3", "1", "t", t) for i, t in enumerate(texts)], "file_ord int, page_ord int, title string, revision_id string, revision_timestamp string, text string")
    rows = specific_paragraphs(pages).collect()
    got = [(r["page_ord"], r["emit_ord"], r["target"], r["section"], r["text"]) for r in rows]
    expected = [(i, k, a.lower(), b, c.strip()) for i, t in enumerate(texts) for k, (a, b, c) in enumerate(read_article(t or ""))]
    assert sorted(got) == sorted(expected) and len(expected) > 5000
    with pytest.raises(Exception, match="No mark in the heading"):
        specific_paragraphs(pages.limit(1).withColumn("text", F.lit("= x\n=== Target without a mark\n"))).collect()


def test_articles_are_dealt_by_size(spark, monkeypatch):
    """A task has so many bytes of articles, whatever their number, and their rows don't depend on it."""
    text = "lead\n== Tools ==\nof these:\none *\nend\n=== Target 1.2: By 2030 ===\nsuch as:\n* a\nthen\n"
    pages = spark.createDataFrame([(0, i, "Sustainable Development Goal 3", "1", "t", text * (i % 5)) for i in range(300)], "file_ord int, page_ord int, title string, revision_id string, revision_timestamp string, text string")
    found = []
    for size, tasks in ((10**6, 1), (1000, -(-len(text) * 600 // 1000))):
        monkeypatch.setattr(articles, "SLICE", size)
        rows = specific_paragraphs(pages)
        assert rows.rdd.getNumPartitions() == articles.slices(pages) == tasks
        found.append(sorted(map(tuple, rows.collect())))
    assert found[0] == found[1] and len(found[0]) > 1000


def test_long_article(spark):
    """A page of 30,000 lines, a third of them in one list."""
    lines = ["a list:", *(f"* entry {i}" for i in range(10_000)), *(f"line {i}" for i in range(20_000))]
    pages = spark.createDataFrame([(0, 0, "Sustainable Development Goal 3", "1", "t", "\n".join(lines))], "file_ord int, page_ord int, title string, revision_id string, revision_timestamp string, text string")
    rows = specific_paragraphs(pages).orderBy("emit_ord").collect()
    assert len(rows) == 20_001 and rows[0]["text"].count(";;") == 10_000 and rows[-1]["text"] == "line 19999"


def brute_noise(spark, sentences, min_df, eps, least):
    rows = boilerplate.tfidf(sentences, min_df, []).collect()
    v = {}
    for r in rows:
        v.setdefault(r["id"], {})[r["term"]] = r["w"]
    ids = [r["id"] for r in sentences.collect()]
    near = {a: [b for b in ids if a in v and b in v and sum(w * v[b].get(t, 0) for t, w in v[a].items()) >= 1 - eps - 1e-9] for a in ids}
    core = {a for a in ids if len(near[a]) >= least}
    return {a for a in ids if a not in core and not core & set(near[a])}


def test_noise(spark):
    import random

    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(200 + i, "alpha beta gamma") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, text string")
    found = {r["id"] for r in boilerplate.noise(df, 3, 0.3, 6, []).collect()}
    assert found == brute_noise(spark, df, 3, 0.3, 6) and 0 < len(found) < len(rows)


def test_numbering(spark):
    rows = [(0, i, 0, "1", t, "s", "", "", "", "", w, 0) for i, (t, w) in enumerate([("1.1", "a"), ("1.1", "b"), ("", "c"), ("", " ".join("w" * 30)), ("1.1", " ".join("w" * 20)), ("bad target", " ".join("w" * 20))])]
    df = spark.createDataFrame(rows, "file_ord int, page_ord int, emit_ord int, goal string, target string, section string, source_url string, title string, revision_id string, revision_timestamp string, excerpt string, part int")
    assert sorted(r["id"] for r in excerpts.number(df).collect()) == ["1_1.1_0", "1_1.1_1", "1__0"]
    packed = df.withColumn("sentences", F.array("excerpt")).drop("excerpt", "part")
    assert excerpts.pack(packed.unionAll(packed.withColumn("page_ord", F.col("page_ord") + 10))).count() == len({r[4] + r[10].lower() for r in rows})


def test_samples(spark):
    rows = [(i, "1", s, f"1.{i % 2}" if s == "Targets" else "") for i, s in enumerate(["Background", "General", "Overall progress", "Targets", "Targets", "Targets", "General"])]
    df = spark.createDataFrame(rows, "id int, goal string, section string, target string")
    assert [r["id"] for r in sampling.goal_sample(df, 3, ["id"]).orderBy("id").collect()] == [0, 1, 6]
    assert sorted(r["id"] for r in sampling.target_sample(df, 1, ["id"]).collect()) == [3, 4]
    assert sampling.training_sample(df, 0, 0, ["id"]).count() == 0
    assert sampling.training_sample(df, 9, 9, ["id"]).count() == 7


def test_split_sizes(spark):
    rows = [(str(i), str(i % 3), (i * 7) % 5 % 3, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, goal string, c3 int, c2 int")
    out = sampling.stratified_split(df, ["c3", "c2"])
    counts = {r["goal"]: (r["v"], r["n"]) for r in out.groupBy("goal").agg(F.sum(F.col("validation").cast("int")).alias("v"), F.count("*").alias("n")).collect()}
    assert all(v == -(-n // 4) for v, n in counts.values()) and sum(n for _, n in counts.values()) == 50
    with pytest.raises(Exception, match="One row only"):
        sampling.stratified_split(spark.createDataFrame([("a", "1", 1, 1)], df.schema), ["c3", "c2"]).collect()


def test_batches_resume(spark):
    rows = [(i, str(i % 17), i) for i in range(170)]
    df = spark.createDataFrame(rows, "id int, label string, pos int")
    whole = sampling.balanced_batches(df, 4).collect()
    later = sampling.balanced_batches(df, 4, start=2).collect()
    assert [r for r in whole if r["iteration"] >= 2] == later
    assert [sum(r["iteration"] == i for r in whole) for i in range(4)] == [64] * 4
    assert [learning.is_checkpoint(i) for i in (0, 4, 5, 9)] == [False, True, False, True]


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def test_tables(spark, tmp_path):
    p = write_csv(tmp_path / "i.csv", ["id", "repeats", "text"], [["1.1.1", "", 'a, "b"\nc'], ["1.2.1", "1.2.1,2.1.1", ""]])
    assert [(r["id"], r["text"]) for r in tables.read_indicators(spark, p).collect()] == [("1.1.1", 'a, "b"\nc'), ("1.2.1", "")]
    with pytest.raises(ValueError):
        tables.read_goals(spark, p)
    few = write_csv(tmp_path / "g.csv", ["id", "links", "text"], [["1", "", "x"]])
    with pytest.raises(ValueError, match="16"):
        tables.read_goals(spark, few)
    e = write_csv(tmp_path / "e.csv", ["id", "extra", "name", "definition", "goal", "target"], [["x", "?", "Rate.", "", "1, 2", "1.1"]])
    raw = tables.read_external(spark, e)
    for option, text in ((0, "Rate."), (1, "Rate."), (2, "Rate. ")):
        row = testsets.external(raw, "MC-IND-SDG", option)[1].first()
        assert (row["repeats"], row["goal"], row["target"], row["text"]) == ("1,2", "1", "1.1", text)


def test_training_and_evaluation(spark, files, tmp_path):
    data = DataExtractor(files, [True, False], min_df=1, stop_words=[]).run(spark)
    rows = data.collect()
    assert [r["goal"] for r in rows] == sorted(r["goal"] for r in rows) and {r["goal"] for r in rows} == {"1", "2"}
    sample = FineTuningDataExtractor(files, [True, False], min_df=1).extract(data, 14, 6)
    assert sample.count() > 4 and "license" in sample.columns
    goal_learner = learning.GoalRepresentationLearner(files, [True, False], min_df=1)
    prepared = goal_learner.load_data(spark, 14)
    assert {(r["goal"], r["y"]) for r in prepared.collect()} == {("1", 0), ("2", 1)}
    ranges = learning.class_ranges(prepared).orderBy("start").collect()
    assert ranges[0]["end"] == ranges[1]["start"]
    texts, ids, y = next(goal_learner.batches(prepared, 1))
    by_goal = {g: min(4, n) for g, n in prepared.groupBy("y").count().collect()}  # two classes, which both give four
    assert len(texts) == len(ids) == len(y) and {g: y.count(g) for g in by_goal} == by_goal

    tests = write_csv(tmp_path / "t.csv", ["id", "repeats", "text"], [[f"{g}.2.{i + 1}", "1.2.1,2.2.1" if i == 0 else "", f"text of number {i} about poverty"] for g in (1, 2) for i in range(6)])
    out = evaluation.Evaluator().run(spark, files, [True, False], tests, "IND-TITLE-AGENDA", 0, "HASHING", "", "", 0, "MC-IND-SDG", (14, 6), 42, str(tmp_path / "res"), min_df=1)
    assert [(r["k"], r["encoder"]) for r in out.collect()] == [(1, "HASHING"), (3, "HASHING")] and all(0 <= r["test"] <= 1 and 0 <= r["validation"] <= 1 for r in out.collect())
    saved = spark.read.csv(str(tmp_path / "res" / "MC-IND-SDG.csv"))
    assert saved.count() == 2
    with pytest.raises(ValueError):
        evaluation.validate("MC-IND-TRG", (14, 6))
    with pytest.raises(ValueError):
        evaluation.test_set(spark, "SDG-TITLE-WIKI", "MC-IND-SDG", 0, tests)


def test_stream(spark, files, tmp_path):
    from corpusloom.streaming.paragraphs import cleaned_paragraphs, write_paragraphs

    pages = read_pages(spark, files, [True, False]).filter("not is_general")
    path, out = str(tmp_path / "pages"), str(tmp_path / "out")
    pages.repartition(2).write.parquet(path)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for _ in range(2):  # started again, it goes on where it was
        query = write_paragraphs(stream, out, str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()
    columns = ["page_ord", "emit_ord", "goal", "target", "section", "text"]
    expected = sorted(map(tuple, cleaned_paragraphs(pages).select(columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == expected and expected


def test_one_scan_of_many_files(spark, tmp_path):
    """500 files in three folders, one a glob, with names that are encoded; the plan has one scan."""
    folders = [tmp_path / n for n in ("a b", "c", "d+é")]
    for f in folders:
        f.mkdir()
    for i in range(500):
        xml(folders[i % 3] / f"{'x' if i % 2 else 'y'}{i}.xml", [(f"P{i}", "t"), (f"Q{i}", "u")])
    given = [f"{folders[0]}/", f"file:{folders[1]}", f"{folders[2]}/x*.xml", f"{folders[2]}/y{{2,5,8}}*.xml"]
    pages = read_pages(spark, given, [True, False, False, True])
    assert pages._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {(r["title"], r["file_ord"], r["is_general"]) for r in pages.collect()}
    expected = set()
    for i in range(500):
        n = i % 3 if i % 3 < 2 else 2 if i % 2 else 3 if str(i)[0] in "258" else None
        if n is not None:
            expected |= {(f"{t}{i}", n, n in (0, 3)) for t in "PQ"}
    assert found == expected
    order = [r["title"] for r in pages.filter("title like '%1'").orderBy("file_ord", "page_ord").collect()]
    assert all(order.index(f"P{i}") < order.index(f"Q{i}") for i in (1, 31, 61, 301))


def test_results_survive_a_retry(spark, tmp_path):
    rows = spark.createDataFrame([(1, "HASHING", 42, 0, 14, 6, None, 0.5), (3, "HASHING", 42, 0, 14, 6, 0.25, 0.75)], tables.RESULT)
    path = str(tmp_path / "r")
    for run in ("a", "b", "a", "a"):
        tables.write_results(rows, path, "MC-IND-SDG", run=run)
    found = tables.read_results(spark, path, "MC-IND-SDG")
    assert sorted((r["run"], r["k"], r["validation"]) for r in found.collect()) == [("a", 1, None), ("a", 3, 0.25), ("b", 1, None), ("b", 3, 0.25)]
    for _ in range(2):
        tables.write_results(rows, path, "MC-IND-SDG")  # a run without a name is one of its own
    assert tables.read_results(spark, path, "MC-IND-SDG").count() == 8
    tables.write_results(rows, path, "MC-IND-SDG", append=False, run="c")
    assert {r["run"] for r in tables.read_results(spark, path, "MC-IND-SDG").collect()} == {"c"}


def test_selection_is_a_sort(spark):
    """The first rows of each group, by histogram, against sorting the group; one group holds most rows, and some keys are equal."""
    rng = random.Random(4)
    rows = [("hot" if i % 8 else f"g{i % 5}", f"{rng.randrange(3000):04x}", i) for i in range(6000)]
    quota = {"hot": 2345, "g0": 0, "g1": 10_000, "g2": 1, "g3": 77, "g4": 150}
    df = spark.createDataFrame([(g, k, i, quota[g]) for g, k, i in rows], "grp string, key string, id int, quota int").repartition(5)
    got = {r["id"] for r in sampling.first_of(df, ["grp"], "key", ["id"], "quota", "inside").filter("inside").collect()}
    expected = set()
    for g, n in quota.items():
        expected |= {i for _, i in sorted((k, i) for x, k, i in rows if x == g)[:n]}
    assert got == expected


def test_draws_leave_tasks_bounded(spark):
    """One class has 5,000 rows in four tasks; from a task come at most `most` draws of an iteration and class."""
    rows = spark.range(0, 5000, 1, 4).select(F.lit("c").alias("label"), F.col("id").cast("string").alias("id"))
    found = sampling._least_draws(rows, range(3), 7, 4).groupBy(F.spark_partition_id().alias("p"), "iteration").count().collect()
    assert len(found) == 12 and {r["count"] for r in found} == {4}
