"""Registered queries of the search engine and their oracle SQL.

Indexes over the driver's tables are built once per session and table folder,
in the shared work folder, and searched by all queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import Engine, id_errors
from quern.functions import analysis
from quern.functions.highlight import snippet
from quern.operators import build
from quern.plans import search
from quern.plans.parser import Page, parse
from quern.sources.catalog import BM25, Definition, Field
from quern.sources.config import Config
from quern.sources.segments import SMALL, Segment, Segments, resolved, should_merge
from quern.sources.storage import unique
from quern.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]

DOCUMENTS = Definition("documents", {"text": Field("text")})
ENGLISH = Definition("documents_en", {"text": Field("text")}, "standard_en")
TUNED = Definition("documents_tuned", {"text": Field("text")}, "standard", BM25(1.4, 0.7))
KEYED = Definition("documents_keyed", {"text": Field("text"), "lang": Field("keyword"), "source": Field("keyword", 0.5)})
PARTS = Definition("parts", {"p_name": Field("text", 2.0), "p_type": Field("text"), "p_brand": Field("keyword")})
TURNS = Definition("conversations", {"text": Field("text"), "role": Field("keyword", 0.25)})

TABLES = {
    "documents": ("documents", "CAST(doc_id AS {s})"), "documents_en": ("documents", "CAST(doc_id AS {s})"), "documents_tuned": ("documents", "CAST(doc_id AS {s})"), "documents_keyed": ("documents", "CAST(doc_id AS {s})"),
    "parts": ("part", "CAST(p_partkey AS {s})"), "conversations": ("conversations", "CAST(conv_id AS {s}) || '-' || CAST(turn AS {s})"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(spark: SparkSession, sf_dir: str, definition: Definition) -> DataFrame:
    name, key = TABLES[definition.name]
    docs = table(spark, sf_dir, name).withColumn("id", F.expr(key.format(s="STRING")))
    # The languages of a document's source and itself, as an array to filter on.
    return docs.withColumn("tags", F.array("lang", "source")) if name == "documents" else docs


_built: dict[tuple[str, str, str], Segments] = {}


def index(spark: SparkSession, sf_dir: str, definition: Definition = DOCUMENTS) -> search.Snapshot:
    """The snapshot of an index over a table, which is built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, definition.name)
    if key not in _built:
        segments = Segments(spark, unique(spark, definition.name), definition)
        segments.write(source_of(spark, sf_dir, definition))
        _built[key] = segments
    return _built[key].snapshot()


def searching(q: str, filters: str = "", definition: Definition = DOCUMENTS, page: int = 1, size: int = 20, strict: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.hits(index(spark, sf_dir, definition), [parse(q, filters)], strict)
        return search.ranked(found, Page(page, size)).select("id", F.round("score", 6).alias("score"))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching("the of", size=10)(spark, sf_dir)


# -- oracle SQL ---------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens_cte(definition: Definition, docs: str = "doc") -> str:
    """CTEs tok (id, field, term, pos, w) and those that follow from it."""
    stop = ", ".join(map(_quoted, analysis.STOPWORDS)) if definition.tokenizer == "standard_en" else ""
    parts = []
    for name, f in definition.fields.items():
        if f.type == "text":
            terms = f"SELECT id, regexp_extract_all(lower({name}), '[\\p{{L}}\\p{{N}}]+') AS t FROM {docs}"
            parts.append(f"SELECT id, '{name}' AS field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos, CAST({f.weight} AS DOUBLE) AS w FROM ({terms})")
        else:
            parts.append(f"SELECT id, '{name}', lower({name}), 0, CAST({f.weight} AS DOUBLE) FROM {docs} WHERE {name} IS NOT NULL")
    where = f" WHERE term NOT IN ({stop})" if stop else ""
    return f"""tok0 AS ({" UNION ALL ".join(parts)}),
tok AS (SELECT * FROM tok0{where}),
post AS (SELECT term, id, sum(w) AS tf, count(*) AS np, list(pos ORDER BY pos) AS ats FROM tok WHERE term <> '' GROUP BY term, id),
dl AS (SELECT id, CAST(sum(np) AS BIGINT) AS dl FROM post GROUP BY id),
st AS (SELECT avg(dl) AS avgdl FROM dl), n AS (SELECT count(*) AS n FROM {docs}), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def doc_cte(definition: Definition) -> str:
    name, key = TABLES[definition.name]
    return f"doc AS (SELECT {key.format(s='VARCHAR')} AS id, * FROM {name})"


def _phrase_sql(words: tuple[str, ...], strict: bool) -> str:
    joins = " ".join(f"JOIN post p{i} ON p{i}.id = p0.id AND p{i}.term = {_quoted(w)}" for i, w in enumerate(words) if i)
    if strict:
        tests = "len(list_filter(p0.ats, lambda x: " + " AND ".join(f"list_contains(p{i}.ats, x + {i})" for i in range(1, len(words))) + ")) > 0"
    else:
        tests = " AND ".join(f"len(list_filter(p0.ats, lambda x: list_contains(p{i}.ats, x + {i}))) > 0" for i in range(1, len(words)))
    return f"SELECT p0.id FROM post p0 {joins} WHERE p0.term = {_quoted(words[0])} AND {tests}"


@dataclass(frozen=True)
class Means:
    """What a query means, written by hand: the SQL knows nothing of the parser."""

    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    without_phrases: tuple[str, ...] = ()
    where: str = "true"

    @property
    def scoring(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.words, *(w for p in self.phrases for w in p.split())]))


def matches_sql(m: Means, strict: bool = False) -> str:
    having = lambda w: f"SELECT id FROM post WHERE term = {_quoted(w)}"
    sets = [having(w) for w in m.scoring] + [_phrase_sql(tuple(p.split()), strict) for p in m.phrases]
    wanted = " INTERSECT ".join(f"({x})" for x in sets) or "SELECT id FROM post WHERE false"
    for gone in [having(w) for w in m.without] + [_phrase_sql(tuple(p.split()), strict) for p in m.without_phrases]:
        wanted = f"({wanted}) EXCEPT ({gone})"
    return wanted


def scored_sql(m: Means, definition: Definition, strict: bool = False) -> str:
    k1, b = definition.bm25.k1, definition.bm25.b
    words = ", ".join(map(_quoted, m.scoring)) or "NULL"
    return f"""SELECT p.id, sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * dl.dl / st.avgdl))) AS score
FROM post p JOIN ({matches_sql(m, strict)}) m ON m.id = p.id JOIN df ON df.term = p.term JOIN dl ON dl.id = p.id CROSS JOIN st CROSS JOIN n
WHERE p.term IN ({words}) AND p.id IN (SELECT id FROM doc WHERE {m.where}) GROUP BY p.id"""


def search_sql(m: Means, definition: Definition = DOCUMENTS, limit: int = 20, offset: int = 0, strict: bool = False) -> str:
    return f"""WITH {doc_cte(definition)}, {tokens_cte(definition)}
SELECT id, round(score, 6) AS score FROM ({scored_sql(m, definition, strict)}) ORDER BY round(score, {search.DECIMALS}) DESC, id LIMIT {limit} OFFSET {offset}"""


# -- queries --------------------------------------------------------------------

TAGS = "list_contains([lower(lang), lower(source)], '{}')"
#: name: (arguments of a search, what they mean, arguments of the SQL).
SEARCHES: dict[str, tuple[dict, Means, dict]] = {
    "search_single_term": ({"q": "with"}, Means(("with",)), {}), "search_and": ({"q": "the of"}, Means(("the", "of")), {}), "search_plus": ({"q": "+the +and of"}, Means(("the", "and", "of")), {}),
    "search_must_not": ({"q": "the -and"}, Means(("the",), without=("and",)), {}), "search_standard_en": ({"q": "this was", "definition": ENGLISH}, Means(("this", "was")), {"definition": ENGLISH}),
    "search_stopword_en": ({"q": "the", "definition": ENGLISH}, Means(("the",)), {"definition": ENGLISH}), "search_unknown_term": ({"q": "qqqqzzzz"}, Means(("qqqqzzzz",)), {}),
    "search_or_is_a_word": ({"q": "the OR of"}, Means(("the", "or", "of")), {}),
    "search_phrase": ({"q": '"of the"'}, Means(phrases=("of the",)), {}), "search_phrase3_loose": ({"q": '"the of and"'}, Means(phrases=("the of and",)), {}),
    "search_phrase3_strict": ({"q": '"the of and"', "strict": True}, Means(phrases=("the of and",)), {"strict": True}), "search_not_phrase": ({"q": 'the "-of the"'}, Means(("the",), without_phrases=("of the",)), {}),
    # A sign before a quote is a token of its own, without a word.
    "search_minus_quote": ({"q": 'was -"of the"'}, Means(("was",), ("of the",)), {}),
    "search_phrase_and_term": ({"q": '"in the" was'}, Means(("was",), ("in the",)), {}),
    "search_weighted_fields": ({"q": "small", "definition": PARTS}, Means(("small",)), {"definition": PARTS}), "search_weighted_fields_and": ({"q": "red widget", "definition": PARTS}, Means(("red", "widget")), {"definition": PARTS}),
    "search_keyword_term": ({"q": "the src3", "definition": KEYED}, Means(("the", "src3")), {"definition": KEYED}), "search_keyword_only": ({"q": "fr", "definition": KEYED}, Means(("fr",)), {"definition": KEYED}),
    "search_conversations": ({"q": "user the", "definition": TURNS}, Means(("user", "the")), {"definition": TURNS}), "search_custom_k1_b": ({"q": "and is", "definition": TUNED}, Means(("and", "is")), {"definition": TUNED}),
    "search_filter_eq": ({"q": "the", "filters": "source:src3"}, Means(("the",), where="source = 'src3'"), {}), "search_filter_eq_casefold": ({"q": "the", "filters": "source:SRC3 lang:EN"}, Means(("the",), where="source = 'src3' AND lang = 'en'"), {}),
    "search_filter_eq_number": ({"q": "ring", "filters": "p_size:11", "definition": PARTS}, Means(("ring",), where="p_size = 11"), {"definition": PARTS}),
    "search_filter_eq_hex_number": ({"q": "ring", "filters": "p_size:0x1.6p3", "definition": PARTS}, Means(("ring",), where="p_size = 11"), {"definition": PARTS}),
    "search_filter_gt": ({"q": "the", "filters": "n_chars>3000"}, Means(("the",), where="n_chars > 3000"), {}), "search_filter_gte": ({"q": "the n_chars>=3000"}, Means(("the",), where="n_chars >= 3000"), {}),
    "search_filter_lt": ({"q": "the", "filters": "n_chars<400"}, Means(("the",), where="n_chars < 400"), {}), "search_filter_lte": ({"q": "the", "filters": "n_chars<=400"}, Means(("the",), where="n_chars <= 400"), {}),
    "search_filter_range": ({"q": "the", "filters": "n_chars:1000-2000"}, Means(("the",), where="n_chars BETWEEN 1000 AND 2000"), {}), "search_filter_open_range": ({"q": "of", "filters": "n_chars:2500-"}, Means(("of",), where="n_chars >= 2500"), {}),
    "search_filter_negated_is_positive": ({"q": "the -source:src3"}, Means(("the",), where="source = 'src3'"), {}),
    "search_filter_array": ({"q": "the", "filters": "tags:src5 tags:en"}, Means(("the",), where=f"{TAGS.format('src5')} AND {TAGS.format('en')}"), {}),
    "search_filter_missing_field": ({"q": "the", "filters": "absent:1"}, Means(("the",), where="false"), {}), "search_filter_number_on_text": ({"q": "the", "filters": "lang>5"}, Means(("the",), where="false"), {}),
    "search_filter_bad_number": ({"q": "the", "filters": "n_chars>abc"}, Means(("the",), where="n_chars > 0"), {}), "search_filter_only_empty": ({"q": "", "filters": "lang:en"}, Means(), {}), "search_only_must_not_empty": ({"q": "-the"}, Means(without=("the",)), {}),
    "search_page2": ({"q": "the", "page": 2, "size": 10}, Means(("the",)), {"limit": 10, "offset": 10}), "search_page_past_end": ({"q": "the", "page": 100000, "size": 10}, Means(("the",)), {"limit": 10, "offset": 999990}),
    "search_page_size_clamped": ({"q": "the", "page": 0, "size": 1000}, Means(("the",)), {"limit": 100}),
}

BATCH: list[tuple[str, Means]] = [
    ("the of", Means(("the", "of"))), ("and -the", Means(("and",), without=("the",))), ('"of the" was', Means(("was",), ("of the",))), ("with n_chars>2000", Means(("with",), where="n_chars > 2000")),
    ("is lang:en", Means(("is",), where="lang = 'en'")), ("the source:src1", Means(("the",), where="source = 'src1'")), ("de la", Means(("de", "la"))), ("der die", Means(("der", "die"))),
    ("-the", Means(without=("the",))), ('"in the"', Means(phrases=("in the",))),
]


def tokenized(definition: Definition) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build.tokens(source_of(spark, sf_dir, definition), definition).groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("pos_sum"))

    return run


def tokenized_sql(definition: Definition) -> str:
    return f"WITH {doc_cte(definition)}, {tokens_cte(definition)} SELECT term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM tok GROUP BY term"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in segment 0; each tenth again, changed, in 1; tombstones of some in 2; some of these again in 3."""
    base = source_of(spark, sf_dir, DOCUMENTS).select("id", "doc_id", "text").withColumn("ordinal", F.col("doc_id"))
    seg = lambda df, k, dead: df.withColumns({"segment_seq": F.lit(k), "_deleted": F.lit(dead)})
    changed = base.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))
    back = base.where("doc_id % 30 = 0").withColumn("text", F.concat(F.lit("again "), "text"))
    return seg(base, 0, False).union(seg(changed, 1, False)).union(seg(base.where("doc_id % 15 = 0"), 2, True)).union(seg(back, 3, False))


VERSIONS_SQL = """base AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents),
v AS (SELECT *, 0 AS seq, false AS dead FROM base UNION ALL SELECT id, doc_id, 'changed ' || text, 1, false FROM base WHERE doc_id % 10 = 0
  UNION ALL SELECT *, 2, true FROM base WHERE doc_id % 15 = 0 UNION ALL SELECT id, doc_id, 'again ' || text, 3, false FROM base WHERE doc_id % 30 = 0),
doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM v) WHERE nth = 1 AND NOT dead)"""


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(versions(spark, sf_dir)).select("id", F.col("segment_seq").alias("segment"), F.md5(F.col("text").cast("binary")).alias("digest"))


def live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = resolved(versions(spark, sf_dir))
    stats = build.corpus_stats(build.lengths(docs, DOCUMENTS, ("id",)))
    return stats.crossJoin(build.average_field_lengths(docs, DOCUMENTS)).select("n", F.round("avgdl", 6).alias("avgdl"), "field", "total", F.round("average", 6).alias("average"))


def segmented(spark: SparkSession, sf_dir: str, compacted: bool = False) -> Segments:
    """An index of the four segments of ``versions``, each written by itself, with tombstones; or what a compaction makes of them."""
    key = (spark.sparkContext.applicationId, sf_dir, f"segmented-{compacted}")
    if key not in _built:
        segments = Segments(spark, unique(spark, "segmented"), DOCUMENTS)
        every = versions(spark, sf_dir)
        for k in range(4):
            segments.write(every.where(F.col("segment_seq") == k).drop("segment_seq"))
        if compacted:
            segments.compact()
        _built[key] = segments
    return _built[key]


def live_search(q: str, compacted: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.ranked(search.hits(segmented(spark, sf_dir, compacted).snapshot(), [parse(q)]), Page(1, 20)).select("id", F.round("score", 6).alias("score"))

    return run


def segment_list(compacted: bool) -> Query:
    """The segments of the manifest, in their order, and what they hold."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = segmented(spark, sf_dir, compacted).segments()
        return spark.createDataFrame([(i, s.documents, s.clean, s.length) for i, s in enumerate(own)], "place int, documents bigint, clean boolean, length bigint")

    return run


def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents of a snapshot of four segments, with the segment that each comes from."""
    return segmented(spark, sf_dir).snapshot().docs.select("id", F.col("segment_seq").alias("segment"), F.md5(F.col("text").cast("binary")).alias("digest"))


def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segmented(spark, sf_dir).snapshot()
    return s.stats.crossJoin(F.broadcast(s.postings.agg(F.count("*").alias("postings")))).select("n", F.round("avgdl", 6).alias("avgdl"), "postings")


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that one request of all benchmark texts is cut into, 16 documents or 400 tokens each."""
    engine = Engine(spark, unique(spark, "requested"), config=Config(flush_max_documents=16, flush_max_postings=400, merge_interval=1.0))
    engine.create_index({"name": "benchmark", "fields": {"text": {"type": "text"}}})
    rows = [{"id": str(r["item_id"]), "text": r["text"]} for r in table(spark, sf_dir, "benchmark").orderBy("item_id").toLocalIterator()]  # a request's documents are the caller's
    engine.index_request("benchmark", rows)
    own = engine.segments("benchmark").segments()
    return spark.createDataFrame([(i, s.documents, s.length) for i, s in enumerate(own)], "segment int, documents bigint, tokens bigint")


REQUEST_SQL = """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY item_id) AS i, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS BIGINT) AS t FROM benchmark),
f(i, segment, d, n) AS (SELECT CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT f.i + 1, CASE WHEN f.d >= 16 OR f.n >= 400 THEN segment + 1 ELSE segment END, CASE WHEN f.d >= 16 OR f.n >= 400 THEN 1 ELSE d + 1 END, CASE WHEN f.d >= 16 OR f.n >= 400 THEN t ELSE n + t END
  FROM f JOIN s ON s.i = f.i + 1)
SELECT segment, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens FROM f JOIN s ON s.i = f.i GROUP BY segment"""


def postings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.select("term", "id", "tf", F.size("positions").cast("bigint").alias("n_positions"), F.col("positions")[0].cast("bigint").alias("first_position"))


def parts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, PARTS).postings.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 6).alias("tf"))


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return build.document_frequency(i.postings).crossJoin(F.broadcast(i.stats)).select("term", "df", F.round(idf, 6).alias("idf"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.lengths(source_of(spark, sf_dir, KEYED), KEYED, ("id",))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, KEYED).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.average_field_lengths(source_of(spark, sf_dir, PARTS), PARTS).select("field", "total", F.round("average", 6).alias("average"))


def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(index(spark, sf_dir), [parse("the -and", "n_chars>500")]).agg(F.count("*").alias("total"))


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(index(spark, sf_dir), [parse("the of")]).select("id", F.round("score", 6).alias("score"))


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, q = index(spark, sf_dir), parse("with the")
    page = search.with_source(i, search.ranked(search.hits(i, [q]), Page(1, 20)).drop("qid"), q)
    return page.select("id", F.round("score", 6).alias("score"), F.col("highlights")["text"].alias("snippet"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of every document that has one; spread out of an array, so that it isn't made for a filter and then again."""
    made = F.array_compact(F.array(snippet(F.col("text"), ["of", "la", "und"])))
    return source_of(spark, sf_dir, DOCUMENTS).select("id", F.explode(made).alias("snippet"))


def snippet_sql(words: str, text: str = "text") -> str:
    norm = "lower(regexp_replace(w, '^[,.!?:;]+|[,.!?:;]+$', '', 'g'))"
    return f"""SELECT id, array_to_string(list_transform(ws[greatest(j - 3, 1):least(j + 3, len(ws))], lambda w: CASE WHEN {norm} IN ({words}) THEN '<em>' || w || '</em>' ELSE w END), ' ') AS snippet
FROM (SELECT id, ws, list_position(list_transform(ws, lambda w: {norm} IN ({words})), true) AS j FROM (SELECT id, list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '') AS ws FROM doc)) WHERE j > 0"""


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked_each(search.hits(index(spark, sf_dir), [parse(q) for q, _ in BATCH]), Page(1, 10))
    return found.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


def batch_sql() -> str:
    each = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS qid, id, score FROM ({scored_sql(m, DOCUMENTS)})" for i, (_, m) in enumerate(BATCH))
    return f"""WITH {doc_cte(DOCUMENTS)}, {tokens_cte(DOCUMENTS)},
every AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, {search.DECIMALS}) DESC, id) AS rank FROM every)
SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"""


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_of(spark, sf_dir, DOCUMENTS).select("id", "doc_id")
    return build.flush_by_documents(docs, 512, ["doc_id"]).groupBy("segment").agg(F.count("*").alias("documents"))


def flushed_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_of(spark, sf_dir, DOCUMENTS)
    sized = docs.select("doc_id", F.size(build.field_tokens(docs, DOCUMENTS)).alias("n_tokens"))
    return build.flush(sized, "n_tokens", 512, 50_000, ["doc_id"]).groupBy("segment").agg(F.count("*").alias("documents"), F.sum("n_tokens").cast("bigint").alias("tokens"))


FLUSH_SQL = f"""WITH RECURSIVE {doc_cte(DOCUMENTS)},
s AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, CAST(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS BIGINT) AS t FROM doc),
f(i, segment, d, n) AS (SELECT CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT f.i + 1, CASE WHEN full_before THEN segment + 1 ELSE segment END, CASE WHEN full_before THEN 1 ELSE d + 1 END, CASE WHEN full_before THEN t ELSE n + t END
  FROM (SELECT *, d >= 512 OR n >= 50000 AS full_before FROM f) f JOIN s ON s.i = f.i + 1)
SELECT segment, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens FROM f JOIN s ON s.i = f.i GROUP BY segment"""


def merge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language, whether segments as large as its sources should be merged."""
    sizes: dict[str | None, list[Segment]] = {}
    for r in table(spark, sf_dir, "documents").groupBy("lang", "source").count().collect():  # a row for each source of a language
        sizes.setdefault(r["lang"], []).append(Segment("s", 0, r["count"], True))
    told = [(lang, len(own), sum(s.documents < SMALL for s in own), should_merge(own)) for lang, own in sizes.items()]
    return spark.createDataFrame(told, "lang string, segments bigint, small bigint, merge boolean")


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some have no id and some an empty one."""
    docs = source_of(spark, sf_dir, DOCUMENTS).withColumn("id", F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE id END"))
    return id_errors(docs).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("documents"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search as ``search_and``, over an index that a stream has filled."""
    root = unique(spark, "streamed")
    engine = Engine(spark, root)
    engine.create_index({"name": "documents", "fields": {"text": {"type": "text"}}})
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, so that the table may be a file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").withColumn("id", F.col("doc_id").cast("string"))
    ingest(engine, "documents", stream, f"{root}/checkpoint").awaitTermination()
    return search.ranked(search.hits(engine.snapshot("documents"), [parse("the of")]), Page(1, 20)).select("id", F.round("score", 6).alias("score"))


def live_sql(*words: str) -> str:
    return f"WITH {VERSIONS_SQL}, {tokens_cte(DOCUMENTS)} SELECT id, round(score, 6) AS score FROM ({scored_sql(Means(words), DOCUMENTS)}) ORDER BY round(score, {search.DECIMALS}) DESC, id LIMIT 20"


OTHERS: dict[str, tuple[Query, str]] = {
    "tokenize_standard": (tokenized(DOCUMENTS), tokenized_sql(DOCUMENTS)), "tokenize_standard_en": (tokenized(ENGLISH), tokenized_sql(ENGLISH)), "tokenize_keyword": (tokenized(KEYED), tokenized_sql(KEYED)),
    "inverted_postings": (postings_summary, f"WITH {doc_cte(DOCUMENTS)}, {tokens_cte(DOCUMENTS)} SELECT term, id, tf, np AS n_positions, CAST(ats[1] AS BIGINT) AS first_position FROM post"),
    "weighted_postings": (parts_postings, f"WITH {doc_cte(PARTS)}, {tokens_cte(PARTS)} SELECT term, count(*) AS df, round(sum(tf), 6) AS tf FROM post GROUP BY term"),
    "idf_table": (idf_table, f"WITH {doc_cte(DOCUMENTS)}, {tokens_cte(DOCUMENTS)} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df CROSS JOIN n"),
    "doc_lengths": (doc_lengths, f"WITH {doc_cte(KEYED)}, {tokens_cte(KEYED)} SELECT doc.id, coalesce(dl, 0) AS dl FROM doc LEFT JOIN dl ON dl.id = doc.id"),
    "corpus_stats": (stats, f"WITH {doc_cte(KEYED)}, {tokens_cte(KEYED)} SELECT n, round(avgdl, 6) AS avgdl FROM n CROSS JOIN st"),
    "avg_field_length": (field_lengths, f"WITH {doc_cte(PARTS)}, {tokens_cte(PARTS)} SELECT field, count(*) AS total, round(count(*) / any_value(n.n), 6) AS average FROM tok CROSS JOIN n GROUP BY field"),
    "search_total_hits": (total_hits, f"WITH {doc_cte(DOCUMENTS)}, {tokens_cte(DOCUMENTS)} SELECT count(*) AS total FROM ({scored_sql(Means(('the',), without=('and',), where='n_chars > 500'), DOCUMENTS)})"),
    "search_all_hits": (all_hits, f"WITH {doc_cte(DOCUMENTS)}, {tokens_cte(DOCUMENTS)} SELECT id, round(score, 6) AS score FROM ({scored_sql(Means(('the', 'of')), DOCUMENTS)})"),
    "search_highlight": (highlighted, f"WITH {doc_cte(DOCUMENTS)}, {tokens_cte(DOCUMENTS)}, r AS (SELECT * FROM ({scored_sql(Means(('with', 'the')), DOCUMENTS)}) ORDER BY round(score, {search.DECIMALS}) DESC, id LIMIT 20), s AS ({snippet_sql(chr(39) + 'with' + chr(39) + ', ' + chr(39) + 'the' + chr(39))}) SELECT r.id, round(score, 6) AS score, snippet FROM r LEFT JOIN s ON s.id = r.id"),
    "snippets": (snippets, f"WITH {doc_cte(DOCUMENTS)} {snippet_sql(chr(39) + 'of' + chr(39) + ', ' + chr(39) + 'la' + chr(39) + ', ' + chr(39) + 'und' + chr(39))}"),
    "multi_query_batch": (batch, batch_sql()),
    "segment_live_docs": (live, f"WITH {VERSIONS_SQL} SELECT id, seq AS segment, md5(text) AS digest FROM doc"),
    "segment_stats_rebuild": (live_stats, f"WITH {VERSIONS_SQL}, {tokens_cte(DOCUMENTS)} SELECT n, round(avgdl, 6) AS avgdl, 'text' AS field, (SELECT count(*) FROM tok) AS total, round((SELECT count(*) FROM tok) / n, 6) AS average FROM n CROSS JOIN st"),
    "segment_search": (live_search("changed the"), live_sql("changed", "the")), "segment_search_again": (live_search("again"), live_sql("again")), "compacted_search": (live_search("changed the", True), live_sql("changed", "the")),
    "segment_snapshot_docs": (snapshot_documents, f"WITH {VERSIONS_SQL} SELECT id, seq AS segment, md5(text) AS digest FROM doc"),
    "segment_snapshot_stats": (snapshot_stats, f"WITH {VERSIONS_SQL}, {tokens_cte(DOCUMENTS)} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM post) AS postings FROM n CROSS JOIN st"),
    "segment_manifest": (segment_list(False), f"WITH {VERSIONS_SQL.split('doc AS (')[0].rstrip().rstrip(',')}, t AS (SELECT seq, dead, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS k FROM v) SELECT seq AS place, count(*) AS documents, NOT bool_or(dead) AS clean, CAST(sum(k) AS BIGINT) AS length FROM t GROUP BY seq"),
    "compacted_manifest": (segment_list(True), f"WITH {VERSIONS_SQL}, {tokens_cte(DOCUMENTS)} SELECT 0 AS place, n AS documents, true AS clean, (SELECT count(*) FROM tok) AS length FROM n"),
    "ingest_request_flush": (requested, REQUEST_SQL),
    "segment_flush_by_docs": (flushed, "SELECT CAST((rn - 1) // 512 AS INTEGER) AS segment, count(*) AS documents FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1"),
    "segment_flush_by_tokens": (flushed_by_tokens, FLUSH_SQL),
    "merge_policy": (merge_policy, "WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT lang, count(*) AS segments, count(*) FILTER (n < 10) AS small FROM s GROUP BY lang) SELECT *, segments > 1 AND (segments >= 4 OR small >= 2) AS merge FROM t"),
    "ingest_validation_errors": (validation, "SELECT CASE WHEN doc_id % 7 = 0 THEN 'document has no id' WHEN doc_id % 11 = 0 THEN 'document id is empty' ELSE 'none' END AS error, count(*) AS documents FROM documents GROUP BY 1"),
    "stream_ingest_search": (streamed, search_sql(Means(("the", "of")))),
}


def queries() -> dict[str, Query]:
    return {name: searching(**kw) for name, (kw, _, _) in SEARCHES.items()} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: search_sql(m, **kw) for name, (_, m, kw) in SEARCHES.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
