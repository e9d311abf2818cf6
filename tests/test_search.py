import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.functions.values import number
from quern.operators import build
from quern.operators.predicates import predicate
from quern.plans import registry
from quern.plans.parser import Page, parse
from quern.plans.search import bucket, hits, ranked, ranked_each, with_source
from quern.sources.catalog import Definition, Field
from quern.sources.segments import Segment, Segments, resolved, should_merge

THREE = Definition("three", {"title": Field("text", 2.0), "body": Field("text"), "tags": Field("keyword", 0.0)})
ROWS = [
    ("1", "Quick brown fox", "jumps over lazy dog", ["animals", "story"], 100, 4.5), ("2", "Fast fox", "quick movements and agile", ["animals"], 200, 4.8), ("3", "Lazy dog", "sleepy dog lies down", ["pets"], 50, 3.0),
]
SCHEMA = "id string, title string, body string, tags array<string>, views int, rating double"


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    segments = Segments(spark, str(tmp_path_factory.mktemp("three")), THREE)
    segments.write(spark.createDataFrame(ROWS, SCHEMA))
    return segments.snapshot()


def run(index, q, filters="", **kw):
    return [(r["id"], round(r["score"], 6)) for r in ranked(hits(index, [parse(q, filters)], **kw), Page()).collect()]


@pytest.mark.parametrize(
    "q, filters, expected",
    [
        ("quick fox", "", [("1", 1.232237), ("2", 1.149796)]), ("+fox -lazy", "", [("2", 0.662456)]), ('"quick brown"', "", [("1", 1.901869)]), ("fox", "views>150", [("2", 0.662456)]),
        ("fox", "rating:4-5", [("2", 0.662456), ("1", 0.616119)]), ("animals", "", [("1", 0.0), ("2", 0.0)]), ("-fox", "", []), ("", "views>1", []), ("zzz", "", []), ("fox", "absent:1", []),
        ("fox", "tags:STORY", [("1", 0.616119)]), ("fox", "-tags:story", [("1", 0.616119)]), ("fox", "tags:7", []), ('fox "-quick brown"', "", [("2", 0.662456)]), ('"brown jumps"', "", []), ('"quick jumps"', "", []),
    ],
)
def test_golden(three, q, filters, expected):
    assert run(three, q, filters) == expected


def test_many_queries_are_one_plan(three):
    found = ranked_each(hits(three, [parse(q) for q in ("quick fox", "-fox", "dog", "fox views>150")]), Page()).collect()
    assert sorted((r["qid"], r["rank"], r["id"]) for r in found) == [(0, 1, "1"), (0, 2, "2"), (2, 1, "3"), (2, 2, "1"), (3, 1, "2")]


def test_phrases_loose_and_strict(spark, tmp_path):
    d = Definition("p", {"t": Field("text")})
    s = Segments(spark, str(tmp_path), d)
    # b follows one a, c comes two after another one.
    s.write(spark.createDataFrame([("x", "a b x x x a y c"), ("y", "a b c")], "id string, t string"))
    assert {i for i, _ in run(s.snapshot(), '"a b c"')} == {"x", "y"}
    assert {i for i, _ in run(s.snapshot(), '"a b c"', strict=True)} == {"y"}


def test_fields_share_positions(spark, tmp_path):
    s = Segments(spark, str(tmp_path), Definition("p", {"title": Field("text"), "body": Field("text")}))
    s.write(spark.createDataFrame([("x", "quick", "the brown")], "id string, title string, body string"))
    assert [i for i, _ in run(s.snapshot(), '"quick brown"')] == ["x"]


def test_highlights(three):
    q = parse("quick fox")
    page = with_source(three, ranked(hits(three, [q]), Page()).drop("qid"), q).collect()
    found = {r["id"]: r["highlights"] for r in page}
    assert found == {"1": {"title": "<em>Quick</em> brown <em>fox</em>"}, "2": {"title": "Fast <em>fox</em>", "body": "<em>quick</em> movements and agile"}}
    assert next(r for r in page if r["id"] == "1")["source"]["views"] == 100


def test_analysis(spark):
    df = spark.createDataFrame([("The quick brown fox and the dog",), ("  ",), (None,), ("Ünïté-42 über",)], "t string")
    found = [r[0] for r in df.select(analysis.simple(["the", "AND "])(F.col("t"))).collect()]
    assert [(x["term"], x["pos"]) for x in found[0]] == [("quick", 1), ("brown", 2), ("fox", 3), ("dog", 6)]
    assert found[1] == [] and found[2] is None and [x["term"] for x in found[3]] == ["ünïté", "42", "über"]
    plain, english = (df.select(F.size(analysis.analyzer_for(n)(F.col("t")))).first()[0] for n in ("custom", " Standard_EN"))
    assert (plain, english) == (7, 4)
    analysis.register("mine", analysis.simple(["quick"]))
    assert df.select(F.size(analysis.analyzer_for("mine")(F.col("t")))).first()[0] == 6


def test_postings_and_lengths(spark):
    d = Definition("b", {"title": Field("text", 2.0), "tags": Field("keyword"), "absent": Field("text")})
    docs = spark.createDataFrame([("1", "quick quick fox", ["Go", ""], 1), ("2", None, None, 2)], "id string, title string, tags array<string>, n int")
    rows = {r["term"]: r for r in build.postings(docs, d, ("id",)).collect()}
    assert rows["quick"]["tf"] == 4.0 and rows["quick"]["positions"] == [0, 1] and set(rows) == {"quick", "fox", "go"}
    assert {r["id"]: r["dl"] for r in build.lengths(docs, d, ("id",)).collect()} == {"1": 4, "2": 0}
    stats = build.corpus_stats(build.lengths(docs, d, ("id",))).first()
    assert (stats["n"], stats["avgdl"]) == (2, 4.0)
    assert {r["field"]: r["average"] for r in build.average_field_lengths(docs, d).collect()} == {"title": 1.5, "tags": 1.0, "absent": 0.0}


def test_filters_on_odd_values(spark):
    df = spark.createDataFrame(
        [("5d", float("nan"), ["a", None]), (" 7 ", 5.0, None), ("1e999", math.inf, []), (None, None, [" B "]), ("0x1p3", 0.0, ["b"])], "s string, x double, t array<string>"
    )

    def rows(text):
        return [r[0] for r in df.select(predicate(df, parse(text).filters[0])).collect()]

    assert rows("s:7") == [False, True, False, False, False]
    assert rows("s:5") == [False] * 5
    assert rows("s>6") == [False, True, False, False, True] and rows("s:8") == [False] * 4 + [True]
    assert rows("x>4") == [False, True, True, False, False]
    assert rows("x:nan") == [False] * 5
    assert rows("x:4-6") == [True, True, False, False, False]
    assert rows("t:b") == [False, False, False, True, True]
    assert rows("S:7") == [False] * 5
    assert rows("x:text") == [False] * 5


def test_flush_rules(spark):
    docs = spark.createDataFrame([(i, 30) for i in range(10)], "i int, size int")
    assert [r[0] for r in build.flush_by_documents(docs, 4, ["i"]).groupBy("segment").count().orderBy("segment").select("count").collect()] == [4, 4, 2]
    by_tokens = build.flush(docs, "size", 0, 70, ["i"]).groupBy("segment").count().orderBy("segment").select("count").collect()
    assert [r[0] for r in by_tokens] == [3, 3, 3, 1]
    assert build.flush(docs, "size", 0, 0, ["i"]).select("segment").distinct().count() == 1


def test_merge_policy():
    seg = lambda n: Segment("s", 0, n, True)
    assert not should_merge([seg(1)]) and should_merge([seg(1), seg(2)]) and not should_merge([seg(1), seg(20)]) and should_merge([seg(20)] * 4)


def test_versions_tombstones_and_compaction(spark, tmp_path):
    d = Definition("v", {"title": Field("text")})
    s = Segments(spark, str(tmp_path), d)
    s.write(spark.createDataFrame([("1", "red fox", False), ("2", "old fox", False)], "id string, title string, _deleted boolean"))
    s.write(spark.createDataFrame([("1", "x", True), ("2", "blue fox", False), ("3", "", None)], "id string, title string, _deleted boolean"))
    assert [i for i, _ in run(s.snapshot(), "fox")] == ["2"] and run(s.snapshot(), "old") == []
    assert s.snapshot().stats.first()["n"] == 2
    stale = s.snapshot(stale_postings=True)
    assert {i for i, _ in run(stale, "old")} == {"2"} and stale.postings.where("term = 'fox'").count() == 2
    before = run(s.snapshot(), "blue")
    made = s.compact()
    assert [x.id for x in s.segments()] == [made.id] and made.clean and made.documents == 2
    assert run(s.snapshot(), "blue") == before
    s.write(spark.createDataFrame([("1", "fox again")], "id string, title string"))
    assert {i for i, _ in run(s.snapshot(), "fox")} == {"1", "2"}
    # A version stays readable as it was.
    assert {i for i, _ in run(s.snapshot(version=1), "fox")} == {"1", "2"} and run(s.snapshot(version=1), "blue") == []


def test_hexadecimal_literals(spark):
    texts = ["0x1p3", "-0X1.8P1", " 0x.8p0 ", "0x10p-4", "0x0p9", "0x1p99999", "0x1p-1074", "0x1.fffffffffffffp1023", "0xp1", "0x1", "0x123456789abcdp-3", "+0x00001p+2", "0x1.8"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(number(F.col("s"), df.schema["s"].dataType)).collect()]
    assert got == [8.0, -3.0, 0.5, 1.0, 0.0, None, 5e-324, float.fromhex("0x1.fffffffffffffp1023"), None, None, float.fromhex("0x123456789abcdp-3"), 4.0, None]


def test_three_writers_lose_nothing(spark, tmp_path):
    d = Definition("v", {"t": Field("text")})

    def work(k):
        own = Segments(spark, str(tmp_path), d)
        for i in range(2):
            own.write(spark.createDataFrame([(f"{k}-{i}-{j}", "word") for j in range(10)], "id string, t string"))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    s = Segments(spark, str(tmp_path), d)
    own = s.segments()
    assert len(own) == 6 and [x.seq for x in own] == list(range(6)) and sum(x.documents for x in own) == 60
    assert hits(s.snapshot(), [parse("word")]).count() == 60


def test_two_compactions_are_one(spark, tmp_path, monkeypatch):
    """The later one finds what it merged gone, and does nothing but clean up."""
    one, other = (Segments(spark, str(tmp_path), Definition("v", {"t": Field("text")})) for _ in range(2))
    for i in range(2):
        one.write(spark.createDataFrame([(f"{i}-{j}", "word") for j in range(20)], "id string, t string"))
    commit = one.replace

    def late(*args):
        other.compact()
        monkeypatch.setattr(one, "replace", commit)
        return commit(*args)

    monkeypatch.setattr(one, "replace", late)
    assert one.compact() is None
    assert [x.documents for x in one.segments()] == [40] and one.snapshot().postings.count() == 40
    assert hits(one.snapshot(), [parse("word")]).count() == 40
    assert one.vacuum() == 0 and one.vacuum(grace=-60) >= 6 and hits(one.snapshot(), [parse("word")]).count() == 40


def test_a_batch_is_applied_once(spark, tmp_path):
    s = Segments(spark, str(tmp_path), Definition("v", {"t": Field("text")}))
    batch = spark.createDataFrame([("1", "word")], "id string, t string")
    assert s.write(batch, 3, "batch-3").seq == 0 and s.write(batch, 3, "batch-3") is None
    assert s.write(batch, 4, "batch-3").seq == 0 and len(s.segments()) == 1, "a named segment keeps its place"
    assert s.manifest()["bytes"] > 0 and hits(s.snapshot(), [parse("word")]).count() == 1


def test_highlights_are_made_above_the_join(three):
    q = parse("quick fox")
    plan = with_source(three, ranked(hits(three, [q]), Page()).drop("qid"), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "<em>" in plan.split("Join Inner")[0] and "<em>" not in plan.split("Join Inner", 1)[1]


def test_compaction_keeps_what_came_meanwhile(spark, tmp_path):
    s = Segments(spark, str(tmp_path), Definition("v", {"t": Field("text")}))
    for i in "12":
        s.write(spark.createDataFrame([(i, "a")], "id string, t string"))
    before = s.segments()
    later = s.write(spark.createDataFrame([("3", "a")], "id string, t string"))
    assert s.replace(before, Segment("merged", 1, 2, True)) and [x.id for x in s.segments()] == ["merged", later.id]
    assert not s.replace(before, Segment("again", 1, 2, True)) and [x.id for x in s.segments()] == ["merged", later.id]


def test_empty_index(spark, tmp_path):
    s = Segments(spark, str(tmp_path), Definition("e", {"t": Field("text")}))
    assert run(s.snapshot(), "a") == []
    s.write(spark.createDataFrame([], "id string, t string"))
    assert run(s.snapshot(), "a") == []


def test_resolved_takes_the_later_row_of_a_segment(spark):
    rows = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "y")], "id string, segment_seq int, ordinal int, t string")
    assert [r["t"] for r in resolved(rows).collect()] == ["y"]


def test_postings_are_written_without_a_shuffle_or_a_sort(spark, tmp_path):
    """What is moved or sorted would be rows of single words, several times the documents, which spill as these grow."""
    told = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    s = Segments(spark, str(tmp_path), Definition("v", {"t": Field("text")}))
    s.write(spark.createDataFrame([(str(i), f"word w{i} w{i % 7}") for i in range(200)], "id string, t string"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = told()  # of which Spark forgets the oldest
    plans = [every.apply(i).physicalPlanDescription() for i in range(every.size())]
    writing = [p for p in plans if f"{tmp_path}/postings/" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert writing and not any(x in p for p in writing for x in ("Exchange", "Sort ", "Sort\n"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) is None
    assert hits(s.snapshot(), [parse("w6")]).count() == 28 and s.segments()[0].length == 600


def test_postings_gathered_in_portions(spark, monkeypatch):
    """Fields' positions in one order, repeated and empty words, whatever the portions; a document's own row tells its length."""
    monkeypatch.setattr(build, "GATHERED", 5)
    monkeypatch.setattr(build, "HANDED", 2)
    rows = [(str(i), " ".join(f"a{j % 3}" for j in range(i)), "a1 a0", ["A1", "", None] if i % 2 else None) for i in range(9)]
    d = Definition("g", {"one": Field("text", 2.0), "two": Field("text"), "tags": Field("keyword", 0.5)})
    found = build.indexed(spark.createDataFrame(rows, "id string, one string, two string, tags array<string>"), d, ("id",), 16).collect()
    expected = {}
    for i, one, two, tags in rows:
        for field, w in ((one.split(), 2.0), (two.split(), 1.0), (["a1"] if tags else [], 0.5)):
            for pos, t in enumerate(field):
                expected.setdefault((i, t), []).append((pos, w))
    of = lambda x: (sum(w for _, w in x), sorted(p for p, _ in x))
    assert {(r["id"], r["term"]): (r["tf"], r["positions"]) for r in found if r["term"]} == {k: of(x) for k, x in expected.items()}
    itself = [r for r in found if r["term"] is None]
    assert {r["id"]: r["dl"] for r in itself} == {i: sum(len(x) for (k, _), x in expected.items() if k == i) for i, *_ in rows} and len(itself) == 9
    assert all(r["term_bucket"] == bucket(r["term"]) for r in found if r["term"]) and {r["term_bucket"] for r in itself} == {build.ITSELF}


def test_a_text_is_split_once_for_its_snippet(spark, tmp_path):
    texts = ["one two three four of, five six seven eight la", "Und so", "none", "", None]
    spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.snippets(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    assert {r["id"]: r["snippet"] for r in found.collect()} == {"0": "two three four <em>of,</em> five six seven", "1": "<em>Und</em> so"}
