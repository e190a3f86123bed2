"""Registered queries over the driver's tables, with equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import normalize as N
from evigraph.functions import similarity as S
from evigraph.ontology import BlockingRule, EntityType, LinkType, Ontology, PropertyDef
from evigraph.operators import analytics, blocking, graph, risk, scoring, traversal, typologies
from evigraph import engine as pipeline
from evigraph.operators.clustering import cluster
from evigraph.operators.merge import build_entities, merged_values
from evigraph.operators.resolve import evaluate, find_errors, resolve_type
from evigraph.ontology import default_ontology
from evigraph.plans.compiler import Engine
from evigraph.plans.english import NaturalLanguage
from evigraph.sources import adapters
from evigraph.runtime import materialize, number_rows, scratch_path, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if there is any."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- normalizers -------------------------------------------------------------------------


def _sql_text(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '\s+', ' ', 'g'))"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_map(names: dict[str, str], word: str) -> str:
    return "CASE " + word + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {word} END"


@query("norm_text_documents", f"SELECT doc_id, {_sql_text('text')} AS norm FROM documents")
def norm_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.norm_text(F.col("text")).alias("norm"))


@query("strip_accents_documents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.strip_accents(F.col("text")).alias("plain"))


@query("norm_id_customer", f"SELECT c_custkey, regexp_replace({_sql_text('c_name')}, '[^a-z0-9]', '', 'g') AS norm FROM customer")
def norm_id_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.norm_id(F.col("c_name")).alias("norm"))


@query(
    "norm_address_url",
    f"""SELECT page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace({_sql_text("url")}, '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> ''),
        lambda w: {_sql_map(N.STREET_WORDS, "w")}), ' ') AS norm FROM pages""",
)
def norm_address_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.norm_address(F.col("url")).alias("norm"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
_PHONE = r"\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@query(
    "norm_email_documents",
    f"""WITH e AS (SELECT doc_id, lower(regexp_extract(text, '{_EMAIL}')) AS raw FROM documents),
        p AS (SELECT doc_id, raw, split_part(regexp_extract(raw, '^(.*)@[^@]*$', 1), '+', 1) AS local, regexp_extract(raw, '@([^@]*)$', 1) AS domain FROM e WHERE raw <> '')
        SELECT doc_id, CASE WHEN local = '' THEN '' WHEN domain IN ('gmail.com', 'googlemail.com') THEN replace(local, '.', '') || '@gmail.com' ELSE local || '@' || domain END AS norm FROM p""",
)
def norm_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", _EMAIL, 0).alias("raw")).where("raw <> ''")
    return raw.select("doc_id", N.norm_email(F.col("raw")).alias("norm"))


@query(
    "norm_phone_documents",
    rf"""SELECT doc_id, right(regexp_replace(raw, '\D', '', 'g'), 10) AS norm FROM (SELECT doc_id, regexp_extract(text, '{_PHONE}') AS raw FROM documents) WHERE raw <> ''""",
)
def norm_phone_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", _PHONE, 0).alias("raw")).where("raw <> ''")
    return raw.select("doc_id", N.norm_phone(F.col("raw")).alias("norm"))


@query(
    "norm_name_parts",
    f"""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(list_filter(string_split(regexp_replace({_sql_text("'Dr. Bill ' || p_name || ' jr'")}, '[^a-z ''-]', ' ', 'g'), ' '), lambda w: w <> ''),
        lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: NOT list_contains({_sql_list(["", *N.TITLES, *N.GENERATIONS])}, w)),
        lambda w: {_sql_map(N.GIVEN_NAMES, "w")}), ' ') AS norm FROM part""",
)
def norm_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit("Dr. Bill "), "p_name", F.lit(" jr"))
    return table(spark, sf_dir, "part").select("p_partkey", N.norm_name(whole).alias("norm"))


@query(
    "norm_org_suppliers",
    f"""WITH t AS (SELECT s_suppkey, regexp_replace(replace({_sql_text("s_name || ' Co., S.A.'")}, '.', ''), '[^a-z0-9 &]', ' ', 'g') AS plain FROM supplier)
        SELECT s_suppkey, coalesce(nullif(array_to_string(list_filter(string_split(plain, ' '), lambda w: w <> '' AND NOT list_contains({_sql_list(N.LEGAL_FORMS)}, w)), ' '), ''), trim(plain)) AS norm FROM t""",
)
def norm_org_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.norm_org(F.concat("s_name", F.lit(" Co., S.A."))).alias("norm"))


@query(
    "norm_date_orders",
    """SELECT o_orderkey, CAST(try_strptime(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d %b %Y') END,
       ['%Y-%m-%d', '%d/%m/%Y', '%d %b %Y']) AS DATE) AS day FROM orders""",
)
def norm_date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.norm_date(text).alias("day"))


@query("norm_number_orders", "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS value FROM orders")
def norm_number_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.norm_number(text).alias("value"))


def _sql_soundex(word: str) -> str:
    letters = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    codes = f"translate(left({letters}, 1) || regexp_replace(substr({letters}, 2), '[hw]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    for d in "123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"upper(left({letters}, 1)) || rpad(left(replace(substr({codes}, 2), '0', ''), 3), 3, '0')"


@query("soundex_parts", f"SELECT DISTINCT word, {_sql_soundex('word')} AS code FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)")
def soundex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", N.soundex(F.col("word")).alias("code"))


# --- similarity --------------------------------------------------------------------------


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of part names that share a brand."""
    names = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    left, right = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    return left.join(right, "p_brand").where("a < b").select("a", "b").distinct()


_PAIRS = "(SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_name < y.p_name)"


def _pair_query(name: str, function: Callable[[Column, Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _name_pairs(spark, sf_dir).select("a", "b", F.round(function(F.col("a"), F.col("b")).cast("double"), 6).alias("sim"))

    query(name, None if sql is None else f"SELECT a, b, round(CAST({sql} AS DOUBLE), 6) AS sim FROM {_PAIRS}")(run)


_pair_query("jaro_parts", S.jaro, "jaro_similarity(a, b)")
_pair_query("jaro_winkler_parts", S.jaro_winkler, "jaro_winkler_similarity(a, b)")
_pair_query("levenshtein_parts", F.levenshtein, "levenshtein(a, b)")
_pair_query("edit_ratio_parts", S.edit_ratio, "1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)")
_pair_query(
    "token_jaccard_parts", S.token_jaccard,
    "len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / CAST(len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS DOUBLE)",
)
_pair_query("exact_parts", S.exact, "CASE WHEN a = b THEN 1.0 ELSE 0.0 END")
# part names have two words of several letters: the best of the four word pairs, then what is left of it
_JW = {(i, j): f"jaro_winkler_similarity(split_part(a, ' ', {i}), split_part(b, ' ', {j}))" for i in (1, 2) for j in (1, 2)}
_PAIRED_SQL = f"""(CASE WHEN greatest({_JW[1, 1]}, {_JW[2, 2]}) > greatest({_JW[1, 2]}, {_JW[2, 1]}) OR {_JW[1, 1]} >= greatest({_JW[1, 2]}, {_JW[2, 1]}) THEN {_JW[1, 1]} + {_JW[2, 2]} ELSE {_JW[1, 2]} + {_JW[2, 1]} END) / 2"""
_pair_query(
    "name_similarity_parts", S.name_similarity,
    f"greatest({_PAIRED_SQL}, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / CAST(len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS DOUBLE))",
)
_pair_query("org_similarity_parts", S.org_similarity, _PAIRED_SQL)


@query(
    "date_similarity_orders",
    """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS a FROM orders),
       g AS (SELECT *, abs(date_diff('day', a, b)) AS gap FROM p WHERE a IS NOT NULL)
       SELECT o_orderkey, round(CAST(CASE WHEN a = b THEN 1.0 WHEN day(a) = month(b) AND month(a) = day(b) AND year(a) = year(b) THEN 0.92
              WHEN gap <= 3 THEN 1.0 - 0.1 * gap WHEN gap <= 366 THEN greatest(0.0, 0.6 - gap / 800.0) ELSE 0.0 END AS DOUBLE), 6) AS sim FROM g""",
)
def date_similarity_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("b"), F.to_date(F.lag("o_orderdate").over(w)).alias("a")).where("a IS NOT NULL")
    return pairs.select("o_orderkey", F.round(S.date_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query(
    "numeric_similarity_parts",
    """WITH p AS (SELECT p_partkey, p_retailprice AS b, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a FROM part)
       SELECT p_partkey, round(coalesce(greatest(0.0, 1.0 - abs(a - b) / 500.0), 0.0), 6) AS sim FROM p""",
)
def numeric_similarity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("b"), F.lag("p_retailprice").over(w).alias("a"))
    return pairs.select("p_partkey", F.round(S.numeric_similarity(F.col("a"), F.col("b"), 500.0), 6).alias("sim"))


# --- resolution of documents -------------------------------------------------------------

DOCUMENT = EntityType(
    "document",
    {
        "text": PropertyDef("text", "address", 0.9, 0.001, 0.7),
        "lang": PropertyDef("lang", "text", 0.98, 0.4, 1.0, comparator="exact"),
    },
    (BlockingRule("start", ("text",), "prefix", 16),),
    match=9.0,
    review=4.5,
)
#: With these thresholds some pairs are left to review.
_REVIEWED = EntityType("document", DOCUMENT.properties, DOCUMENT.blocking, match=9.0, review=-12.0)
_DOC_ID = EntityType("document", {**DOCUMENT.properties, "source": PropertyDef("source", "id", 0.9, 1e-6, 1.0)}, DOCUMENT.blocking)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), "source", F.nullif(N.norm_text(F.col("text")), F.lit("")).alias("text"), "lang"
    )


def _scored(spark: SparkSession, sf_dir: str, entity: EntityType = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    records = materialize(_records(spark, sf_dir), "records")
    return records, scoring.score_pairs(records, blocking.candidate_pairs(records, entity), entity)


_T, _L = DOCUMENT.properties["text"], DOCUMENT.properties["lang"]
_DOCS_SQL = f"""
docs AS (SELECT doc_id AS pos, 'doc:' || doc_id AS key, source, lang, {_sql_text("text")} AS text FROM documents),
keys AS (SELECT pos, 'start:' || left(text, 16) AS block FROM docs WHERE text <> ''),
sizes AS (SELECT block, count(*) AS n, min(pos) AS first_pos FROM keys GROUP BY 1),
cand AS (SELECT a.pos AS l, b.pos AS r, min(s.first_pos) AS first_pos FROM keys a JOIN keys b ON a.block = b.block AND a.pos < b.pos JOIN sizes s ON s.block = a.block WHERE s.n BETWEEN 2 AND 400 GROUP BY 1, 2),
sims AS (SELECT l, r, len(list_intersect(list_distinct(string_split(x.text, ' ')), list_distinct(string_split(y.text, ' ')))) / CAST(len(list_distinct(list_concat(string_split(x.text, ' '), string_split(y.text, ' ')))) AS DOUBLE) AS st,
  CASE WHEN x.lang = y.lang THEN 1.0 ELSE 0.0 END AS sl FROM cand JOIN docs x ON x.pos = l JOIN docs y ON y.pos = r),
scored AS (SELECT l, r, st, sl, CASE WHEN st >= {_T.threshold} THEN {_T.agree!r} WHEN st <= {_T.partial_floor!r} THEN {_T.disagree!r}
  ELSE {_T.disagree!r} + (st - {_T.partial_floor!r}) / {_T.threshold - _T.partial_floor!r} * {_T.agree - _T.disagree!r} END AS wt,
  CASE WHEN sl >= 1 THEN {_L.agree!r} ELSE {_L.disagree!r} END AS wl FROM sims),
pairs AS (SELECT l, r, st, sl, wt, wl, CAST(wt + wl AS DOUBLE) AS score, CASE WHEN wt + wl >= 9.0 THEN 'match' WHEN wt + wl >= 4.5 THEN 'review' ELSE 'no-match' END AS verdict FROM scored)
"""
_CLUSTER_SQL = f"""WITH RECURSIVE {_DOCS_SQL},
m AS (SELECT l AS a, r AS b FROM pairs WHERE verdict = 'match' UNION SELECT r, l FROM pairs WHERE verdict = 'match'),
reach(a, b) AS (SELECT pos, pos FROM docs UNION SELECT reach.a, m.b FROM reach JOIN m ON m.a = reach.b),
clusters AS (SELECT a AS pos, min(b) AS cluster FROM reach GROUP BY 1)
"""


@query("blocking_docs", f"WITH {_DOCS_SQL} SELECT pos, block FROM keys")
def blocking_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.blocking_keys(_records(spark, sf_dir), DOCUMENT).select("pos", "block")


@query(
    "blocking_letters_parts",
    """SELECT p_partkey AS pos, 'letters:' || left(array_to_string(list_sort(list_filter(string_split(replace(p_name, ' ', ''), ''), lambda c: c <> '')), ''), 6) AS block FROM part""",
)
def blocking_letters_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = EntityType("part", {"name": PropertyDef("name")}, (BlockingRule("letters", ("name",), "sorted_tokens", 6),))
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return blocking.blocking_keys(records, entity).select("pos", "block")


@query(
    "blocking_soundex_parts",
    f"""SELECT p_partkey AS pos, 'sound:' || ({_sql_soundex("split_part(p_name, ' ', 1)")}) || ({_sql_soundex("split_part(p_name, ' ', -1)")}) AS block FROM part""",
)
def blocking_soundex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = EntityType("part", {"name": PropertyDef("name")}, (BlockingRule("sound", ("name",), "soundex"),))
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return blocking.blocking_keys(records, entity).select("pos", "block")


_CUSTOMER = EntityType(
    "customer", {n: PropertyDef(n) for n in ("name", "nation", "segment")},
    (BlockingRule("nation", ("nation",)), BlockingRule("both", ("nation", "segment")), BlockingRule("sound", ("segment",), "soundex"), BlockingRule("tail", ("name",), "prefix", 14)),
)
_CUSTOMER_KEYS = f"""keys AS (SELECT c_custkey AS pos, unnest(['nation:' || c_nationkey, 'both:' || c_nationkey || '|' || c_mktsegment, 'sound:' || ({_sql_soundex("c_mktsegment")}) || ({_sql_soundex("c_mktsegment")}),
  'tail:' || left(c_name, 14)]) AS block, unnest([0, 1, 2, 3]) AS rule FROM customer)"""


def _customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))


@query("blocking_rules_customers", f"WITH {_CUSTOMER_KEYS} SELECT pos, rule, block FROM keys")
def blocking_rules_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys of one and two properties, soundex and prefix: the union of four rules."""
    return blocking.blocking_keys(_customer_records(spark, sf_dir), _CUSTOMER)


@query(
    "candidate_pairs_customers",
    f"""WITH {_CUSTOMER_KEYS}, sizes AS (SELECT block, count(*) AS n, min(pos) AS first_pos FROM keys GROUP BY 1)
        SELECT a.pos AS l, b.pos AS r, min(s.first_pos) AS first_pos FROM keys a JOIN keys b ON a.block = b.block AND a.pos < b.pos JOIN sizes s ON s.block = a.block WHERE s.n BETWEEN 2 AND 60 GROUP BY 1, 2""",
)
def candidate_pairs_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that several rules make count once; blocks of more than 60 records are left out."""
    return blocking.candidate_pairs(_customer_records(spark, sf_dir), _CUSTOMER, 60).select("l", "r", "first_pos")


@query("block_stats_docs", f"WITH {_DOCS_SQL} SELECT count(*) AS blocks, coalesce(max(n), 0) AS largest_block, count(*) FILTER (WHERE n > 400) AS skipped_blocks FROM sizes")
def block_stats_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_statistics(_records(spark, sf_dir), DOCUMENT)


@query("candidate_pairs_docs", f"WITH {_DOCS_SQL} SELECT l, r, first_pos FROM cand")
def candidate_pairs_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidate_pairs(_records(spark, sf_dir), DOCUMENT).select("l", "r", "first_pos")


@query("score_docs", f"WITH {_DOCS_SQL} SELECT l, r, round(score, 6) AS score FROM pairs")
def score_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("l", "r", F.round("score", 6).alias("score"))


@query("match_verdicts_docs", f"WITH {_DOCS_SQL} SELECT l, r, round(score, 6) AS score, verdict FROM pairs")
def match_verdicts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("l", "r", F.round("score", 6).alias("score"), "verdict")


@query("review_queue_docs", f"WITH {_DOCS_SQL} SELECT l, r, round(score, 6) AS score FROM pairs WHERE score < 9.0 AND score >= -12.0 ORDER BY round(score, 6) DESC, l, r LIMIT 500")
def review_queue_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir, _REVIEWED)[1].where("verdict = 'review'").select("l", "r", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "l", "r").limit(500)


@query(
    "explain_docs",
    f"""WITH {_DOCS_SQL} SELECT l, r, 'text' AS prop, round(st, 6) AS sim, round(CAST(wt AS DOUBLE), 6) AS weight FROM pairs
        UNION ALL SELECT l, r, 'lang', CAST(sl AS DOUBLE), round(CAST(wl AS DOUBLE), 6) FROM pairs""",
)
def explain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scored(spark, sf_dir)[1].select("l", "r", F.explode("evidence").alias("e"))
    return found.select("l", "r", "e.prop", F.round("e.sim", 6).alias("sim"), F.round("e.weight", 6).alias("weight"))


@query("strongest_evidence_docs", f"WITH {_DOCS_SQL} SELECT l, r, CASE WHEN abs(wt) >= abs(wl) THEN 'text' ELSE 'lang' END AS prop FROM pairs")
def strongest_evidence_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property that says most about each pair, for or against."""
    found = _scored(spark, sf_dir)[1].select("l", "r", F.array_sort("evidence", lambda x, y: F.when(F.abs(x["weight"]) > F.abs(y["weight"]), -1).when(F.abs(x["weight"]) < F.abs(y["weight"]), 1).otherwise(0)).alias("e"))
    return found.select("l", "r", F.element_at("e", 1)["prop"].alias("prop"))


_SHELF = EntityType("shelf", {"names": PropertyDef("names", "name", 0.9, 0.05, 0.9, multi=True)})
_SHELF_SQL = f"""shelves AS (SELECT DISTINCT p_size * 1000 + CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS pos, p_size, p_name FROM part),
  met AS (SELECT x.pos AS l, y.pos AS r, x.p_name AS a, y.p_name AS b FROM shelves x JOIN shelves y ON x.p_size = y.p_size AND x.pos < y.pos)"""


@query(
    "score_lists_parts",
    f"""WITH {_SHELF_SQL} SELECT l, r, round(max(CASE WHEN a = b THEN 1.0 ELSE greatest({_PAIRED_SQL}, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / CAST(len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS DOUBLE)) END), 6) AS sim FROM met GROUP BY 1, 2""",
)
def score_lists_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelves hold lists of names; two are as similar as their most similar names."""
    pos = (F.col("p_size") * 1000 + F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")).cast("long")
    shelves = table(spark, sf_dir, "part").groupBy(pos.alias("pos"), "p_size").agg(F.collect_set("p_name").alias("names"))
    sizes = shelves.select(F.col("pos").alias("l"), "p_size").join(shelves.select(F.col("pos").alias("r"), "p_size"), "p_size").where("l < r").select("l", "r")
    found = scoring.score_pairs(shelves, sizes, _SHELF)
    return found.select("l", "r", F.round(F.element_at("evidence", 1)["sim"], 6).alias("sim"))


def _clusters(spark: SparkSession, sf_dir: str, entity: EntityType = DOCUMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, scored = _scored(spark, sf_dir, entity)
    return records, *cluster(records, scored.where("verdict = 'match'"), entity)


@query("cluster_docs", f"{_CLUSTER_SQL} SELECT pos, cluster FROM clusters")
def cluster_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[1]


@query("cluster_docs_veto")
def cluster_docs_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, _DOC_ID)[1]


_MERGED = """vals AS (SELECT cluster, prop, value, count(*) AS n, min(pos) AS first FROM
  (SELECT c.cluster, c.pos, unnest(['text', 'lang']) AS prop, unnest([d.text, d.lang]) AS value FROM clusters c JOIN docs d USING (pos)) WHERE value <> '' GROUP BY 1, 2, 3),
best AS (SELECT cluster, prop, value FROM vals QUALIFY row_number() OVER (PARTITION BY cluster, prop ORDER BY n DESC, length(value) DESC, first) = 1)"""


@query("merge_props_docs", f"{_CLUSTER_SQL}, {_MERGED} SELECT cluster, prop, value FROM best")
def merge_props_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, clusters, _ = _clusters(spark, sf_dir)
    return merged_values(records, clusters, DOCUMENT).select("cluster", "prop", F.element_at("values", 1).alias("value"))


_MANY = EntityType("document", {"source": PropertyDef("source", "raw", multi=True)}, DOCUMENT.blocking)


@query(
    "merge_lists_docs",
    f"""{_CLUSTER_SQL}, s AS (SELECT cluster, source, min(pos) AS first FROM clusters JOIN docs USING (pos) WHERE source <> '' GROUP BY 1, 2)
        SELECT cluster, string_agg(source, ',' ORDER BY first) AS value FROM s GROUP BY 1""",
)
def merge_lists_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of many values keeps each of them, in order of appearance."""
    records, clusters, _ = _clusters(spark, sf_dir)
    return merged_values(records, clusters, _MANY).where("prop = 'source'").select("cluster", F.concat_ws(",", "values").alias("value"))


@query(
    "resolution_totals_docs",
    f"""{_CLUSTER_SQL} SELECT 'records' AS measure, count(*) AS n FROM docs UNION ALL SELECT 'blocks', count(*) FROM sizes UNION ALL SELECT 'largest_block', coalesce(max(n), 0) FROM sizes
        UNION ALL SELECT 'skipped_blocks', count(*) FILTER (WHERE n > 400) FROM sizes UNION ALL SELECT 'candidate_pairs', count(*) FROM pairs UNION ALL SELECT 'matches', count(*) FILTER (WHERE verdict = 'match') FROM pairs
        UNION ALL SELECT 'review', count(*) FILTER (WHERE verdict = 'review') FROM pairs UNION ALL SELECT 'conflicts_blocked', 0 UNION ALL SELECT 'entities', count(DISTINCT cluster) FROM clusters""",
)
def resolution_totals_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve_type(_records(spark, sf_dir), Ontology("documents", {"document": DOCUMENT}, {}), "document")
    return spark.createDataFrame(list(got.total().items()), "measure string, n long")


@query("unresolved_nations", "SELECT 'NAT-' || lpad(CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR), 6, '0') AS id, 'geo:' || n_nationkey AS members, lower(n_name) AS name FROM nation")
def unresolved_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type without blocking rules is not resolved: every record is an entity."""
    nations = table(spark, sf_dir, "nation")
    records = nations.select(F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("geo:"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("geo").alias("source"), N.norm_text(F.col("n_name")).alias("name"))
    kind = EntityType("nation", {"name": PropertyDef("name")})
    got = resolve_type(records, Ontology("places", {"nation": kind}, {}), "nation").entities
    return got.select("id", F.concat_ws(",", "members").alias("members"), F.element_at(F.element_at("props", "name"), 1).alias("name"))


@query(
    "entity_ids_docs",
    f"""{_CLUSTER_SQL}, n AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS ord FROM (SELECT DISTINCT cluster FROM clusters))
        SELECT 'DOC-' || lpad(CAST(ord AS VARCHAR), 6, '0') AS id, string_agg(key, ',' ORDER BY pos) AS members, count(*) AS records,
               round(CAST(least(1.0, 0.55 + 0.15 * count(*)) AS DOUBLE), 6) AS confidence
        FROM clusters JOIN n USING (cluster) JOIN docs USING (pos) GROUP BY ord""",
)
def entity_ids_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, clusters, _ = _clusters(spark, sf_dir)
    entities, _ = build_entities(records, clusters, DOCUMENT)
    return entities.select("id", F.concat_ws(",", "members").alias("members"), F.size("members").cast("long").alias("records"), F.round("confidence", 6).alias("confidence"))


_TRUTH = "labelled AS (SELECT c.cluster, min(d.pos) OVER (PARTITION BY d.text) AS truth FROM clusters c JOIN docs d USING (pos))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their cluster, and as truth the first document of the same normalized text."""
    records, clusters, _ = _clusters(spark, sf_dir)
    named = records.select("pos", F.coalesce("text", F.lit("")).alias("content"))
    truth = named.groupBy("content").agg(F.min("pos").alias("truth"))
    return named.join(truth, "content").select("pos", "truth").join(clusters, "pos").select(
        F.lit("document").alias("entity_type"), F.col("cluster").cast("string").alias("entity_id"), F.col("truth").cast("string").alias("truth_id")
    )


@query(
    "evaluate_docs",
    f"""{_CLUSTER_SQL}, {_TRUTH}, cells AS (SELECT cluster, truth, count(*) AS n FROM labelled GROUP BY 1, 2),
        s AS (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM cells) AS tp, (SELECT CAST(sum(m * (m - 1) // 2) AS BIGINT) FROM (SELECT sum(n) AS m FROM cells GROUP BY cluster)) AS predicted,
              (SELECT CAST(sum(m * (m - 1) // 2) AS BIGINT) FROM (SELECT sum(n) AS m FROM cells GROUP BY truth)) AS actual)
        SELECT tp, predicted, actual, round(CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 1.0 END, 6) AS precision, round(CASE WHEN actual > 0 THEN tp / CAST(actual AS DOUBLE) ELSE 1.0 END, 6) AS recall FROM s""",
)
def evaluate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(_labelled(spark, sf_dir)).where("entity_type = 'overall'").select("tp", "predicted", "actual", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "find_errors_docs",
    f"""{_CLUSTER_SQL}, {_TRUTH} SELECT CAST(cluster AS VARCHAR) AS entity_id, string_agg(DISTINCT CAST(truth AS VARCHAR), ',' ORDER BY CAST(truth AS VARCHAR)) AS truths, count(*) AS records
        FROM labelled GROUP BY cluster HAVING count(DISTINCT truth) > 1 ORDER BY CAST(cluster AS VARCHAR) LIMIT 10""",
)
def find_errors_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, _ = find_errors(_labelled(spark, sf_dir), 10)
    return merges.select("entity_id", F.concat_ws(",", "truths").alias("truths"), "records")


@query(
    "key_merge_events",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (WHERE value > 50) AS value FROM events GROUP BY 1""",
)
def key_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return adapters.merge_by_key(events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


# --- intake ------------------------------------------------------------------------------


def _taken_in(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """``(kind, pos, key, value)``: the records and links that a source file of these rows yields.

    The rows are written as the file, in parts that follow each other in the order given by ``ord``,
    and read back by the adapter.
    """
    folder = scratch_path(spark, "intake")
    lines = rows.orderBy("ord").drop("ord")
    lines.write.csv(f"{folder}/{name}", header=True) if name.endswith(".csv") else lines.write.json(f"{folder}/{name}")
    got, ontology = adapters.ingest(spark, folder, default_ontology()), default_ontology()
    out = None
    for kind, records in got.records.items():
        shown = [F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in ontology.entity(kind).properties if p in records.columns]
        part = records.select(F.lit(kind).alias("kind"), "pos", "key", F.concat_ws(";", *shown).alias("value"))
        out = part if out is None else out.unionByName(part)
    if got.links is not None:
        value = F.concat_ws(";", "source_key", "target_key", F.col("amount").cast("decimal(18,2)").cast("string"), "date", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))
        out = out.unionByName(got.links.select(F.col("link_type").alias("kind"), F.col("ord").alias("pos"), F.col("link_key").alias("key"), value.alias("value")))
    return out


@query(
    "intake_natreg",
    """WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), home AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM c WHERE c_custkey % 3 > 0)
       SELECT 'person' AS kind, n AS pos, 'natreg:R' || c_custkey AS key, 'full_name=ann customer' || CASE WHEN c_custkey % 5 = 0 THEN ';dob=1970-01-0' || (1 + c_custkey % 9) ELSE '' END || ';national_id=n' || c_custkey ||
         CASE WHEN c_custkey % 3 > 0 THEN ';address=' || c_custkey || ' mill street' ELSE '' END || ';nationality=c' || c_nationkey AS value FROM c
       UNION ALL SELECT 'location', k, 'natreg:LOCR' || c_custkey, 'address=' || c_custkey || ' mill street;city=town ' || c_nationkey || ';country=c' || c_nationkey FROM home
       UNION ALL SELECT 'resides_at', k, 'natreg:RESR' || c_custkey, 'natreg:R' || c_custkey || ';natreg:LOCR' || c_custkey || ';' FROM home""",
)
def intake_natreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return _taken_in(spark, "natreg_persons.csv", table(spark, sf_dir, "customer").select(
        k.alias("ord"), text("R", k).alias("record_id"), F.lit("CUSTOMER").alias("surname"), F.lit("Ann").alias("given_names"), F.when(k % 5 == 0, text("1970-01-0", 1 + k % 9)).alias("date_of_birth"),
        text("N-", k).alias("national_id"), F.when(k % 3 > 0, text(k, " Mill St.")).alias("residential_address"), text("Town  ", F.col("c_nationkey")).alias("city"), text("C", F.col("c_nationkey")).alias("country"), F.lit("xx").alias("nationality"),
    ))


@query(
    "intake_hr",
    """WITH s AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), e AS (SELECT c_nationkey, min(n) AS first, max(n) AS last, max(n) FILTER (WHERE c_custkey % 4 > 0) AS named FROM s GROUP BY 1)
       SELECT 'person' AS kind, n AS pos, 'hr:H' || c_custkey AS key, 'full_name=robert staff;email=bob' || c_custkey || '@corp.com' || CASE WHEN c_custkey % 2 = 0 THEN ';phone=71230000' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') ELSE '' END || ';occupation=' || lower(c_mktsegment) AS value FROM s
       UNION ALL SELECT 'organization', row_number() OVER (ORDER BY first) - 1, 'hr:E' || e.c_nationkey, 'legal_name=' || CASE WHEN named IS NULL THEN '' ELSE 'works ' || (SELECT c_custkey FROM s WHERE s.n = named) END || ';country=c' || e.c_nationkey FROM e
       UNION ALL SELECT 'employed_by', n, 'hr:EMPH' || c_custkey, 'hr:H' || c_custkey || ';hr:E' || c_nationkey || ';01/02/2019;role=' || c_mktsegment || ',since=01/02/2019' FROM s""",
)
def intake_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employers repeat on every row; their last name in file order that is not empty counts."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return _taken_in(spark, "hr_directory.csv", table(spark, sf_dir, "customer").select(
        k.alias("ord"), text("H", k).alias("staff_id"), F.lit("Dr Bob Staff").alias("display_name"), F.lit(None).cast("string").alias("date_of_birth"), text("Bob", k, "+x@Corp.com").alias("work_email"),
        F.when(k % 2 == 0, text("+44 7123 0000 ", F.lpad((k % 100).cast("string"), 2, "0"))).alias("mobile"), F.col("c_mktsegment").alias("job_title"), text("E", F.col("c_nationkey")).alias("employer_id"),
        F.when(k % 4 > 0, text("Works ", k, " Ltd")).alias("employer_name"), text("C", F.col("c_nationkey")).alias("employer_country"), F.lit("01/02/2019").alias("start_date"),
    ))


@query(
    "intake_bank",
    """WITH b AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY c_custkey % 3 > 0 ORDER BY c_custkey) - 1 AS m FROM b)
       SELECT 'account' AS kind, n AS pos, 'bank:K' || c_custkey || 'A' AS key, 'account_number=acc' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ';iban=xb' || c_custkey ELSE '' END || ';institution=first bank;currency=eur;opened=2018-03-05' AS value FROM b
       UNION ALL SELECT 'person', m, 'bank:K' || c_custkey || 'H', 'full_name=ann holder;dob=1970-02-01' FROM p WHERE c_custkey % 3 > 0
       UNION ALL SELECT 'organization', m, 'bank:K' || c_custkey || 'H', 'legal_name=holder ' || c_custkey || ';reg_number=r' || c_custkey || ';country=de' FROM p WHERE c_custkey % 3 = 0
       UNION ALL SELECT CASE WHEN c_custkey % 3 > 0 THEN 'owns_account' ELSE 'controls_account' END, n, CASE WHEN c_custkey % 3 > 0 THEN 'bank:OWNK' ELSE 'bank:CTLK' END || c_custkey, 'bank:K' || c_custkey || 'H;bank:K' || c_custkey || 'A;' FROM b""",
)
def intake_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    mine = k % 3 > 0
    return _taken_in(spark, "bank_kyc.jsonl", table(spark, sf_dir, "customer").select(
        k.alias("ord"), text("K", k).alias("kyc_id"), text("ACC-", k).alias("account_no"), F.when(k % 2 == 0, text("XB ", k)).alias("iban"), F.lit("First Bank AG").alias("bank"), F.lit("EUR").alias("ccy"), F.lit("05/03/2018").alias("opened_on"),
        F.when(mine, "individual").otherwise("corporate").alias("holder_type"), F.when(mine, F.lit("Mrs Ann HOLDER")).otherwise(text("Holder ", k, " GmbH")).alias("holder_name"), F.when(mine, F.lit("01 Feb 1970")).alias("holder_dob"),
        F.when(~mine, text("R-", k)).alias("holder_reg"), F.when(~mine, F.lit("DE")).alias("holder_country"),
    ))


@query(
    "intake_corpreg",
    """WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier), o AS (SELECT s.s_suppkey, s.n, k FROM s, (SELECT unnest([0, 1]) AS k) WHERE k <= s.s_suppkey % 2),
       links AS (SELECT 'registered_at' AS kind, n, 0 AS k, 'corpreg:REGC' || s_suppkey AS key, 'corpreg:C' || s_suppkey || ';corpreg:LOCC' || s_suppkey || ';' AS value, 0 AS phase FROM s
         UNION ALL SELECT 'officer_of', n, k + 1, 'corpreg:OFFF' || s_suppkey || '-' || k, 'corpreg:F' || s_suppkey || '-' || k || ';corpreg:C' || s_suppkey || ';2022-07-01;role=director,since=2022-07-01', 0 FROM o
         UNION ALL SELECT 'owns_stake', n, 0, 'corpreg:SH' || lpad(CAST(row_number() OVER (ORDER BY n) - 1 AS VARCHAR), 5, '0'), 'corpreg:C' || s_suppkey || ';corpreg:C' || (s_suppkey - 1) || ';percent=25.0', 1 FROM s WHERE s_suppkey > 0)
       SELECT 'organization' AS kind, n AS pos, 'corpreg:C' || s_suppkey AS key, 'legal_name=firm ' || s_suppkey || ';reg_number=r' || s_suppkey || ';country=cy;address=' || s_suppkey || ' harbour road;incorporated=2022-06-01;sector=shipping' AS value FROM s
       UNION ALL SELECT 'location', n, 'corpreg:LOCC' || s_suppkey, 'address=' || s_suppkey || ' harbour road;city=nicosia;country=cy;postcode=1066' FROM s
       UNION ALL SELECT 'person', row_number() OVER (ORDER BY n, k) - 1, 'corpreg:F' || s_suppkey || '-' || k, 'full_name=director ' || CASE k WHEN 0 THEN 'one' ELSE 'two' END || ';nationality=cy' FROM o
       UNION ALL SELECT kind, row_number() OVER (ORDER BY phase, n, k) - 1, key, value FROM links""",
)
def intake_corpreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with one or two officers, then the stakes that each holds in the one before."""
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    officer = lambda i, name: F.struct(text("F", k, f"-{i}").alias("officer_id"), F.lit(f"Director {name}").alias("name"), F.lit(None).cast("string").alias("dob"), F.lit("director").alias("role"), F.lit("2022-07-01").alias("appointed"), F.lit("CY").alias("nationality"))
    suppliers = table(spark, sf_dir, "supplier")
    firms = suppliers.select(
        k.alias("ord"), text("C", k).alias("entry_id"), F.lit("company").alias("entry_kind"), text("Firm ", k, " Ltd").alias("company_name"), text("R-", k).alias("registration_number"), F.lit("CY").alias("jurisdiction"), F.lit("2022-06-01").alias("incorporated_on"), F.lit("shipping").alias("sic_description"),
        F.struct(text(k, " Harbour Rd").alias("street"), F.lit("Nicosia").alias("city"), F.lit("1066").alias("postcode"), F.lit("CY").alias("country")).alias("registered_office"), F.slice(F.array(officer(0, "One"), officer(1, "Two")), F.lit(1), (k % 2 + 1).cast("int")).alias("officers"),
    )
    stakes = suppliers.where(k > 0).select((k - 1_000_000_000).alias("ord"), F.lit("shareholding").alias("entry_kind"), text("R-", k).alias("parent_reg"), text("R-", k - 1).alias("child_reg"), F.lit(25.0).alias("percent"))
    return _taken_in(spark, "company_registry.jsonl", firms.unionByName(stakes, allowMissingColumns=True))


@query(
    "intake_transactions",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), side AS (SELECT 'C' || o_custkey AS a, n, 0 AS k FROM o UNION ALL SELECT 'P' || left(o_orderpriority, 1), n, 1 FROM o),
       f AS (SELECT a, min(n * 2 + k) AS first FROM side GROUP BY 1)
       SELECT 'account' AS kind, row_number() OVER (ORDER BY first) - 1 AS pos, 'txn:ACC' || a AS key, 'account_number=' || lower(a) AS value FROM f
       UNION ALL SELECT 'transacted', n, 'txn:T' || o_orderkey, 'txn:ACCC' || o_custkey || ';txn:ACCP' || left(o_orderpriority, 1) || ';' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || ';' || strftime(o_orderdate, '%Y-%m-%d') || ';currency=EUR,reference=order' FROM o""",
)
def intake_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _taken_in(spark, "transactions.jsonl", table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.concat(F.lit("T"), k.cast("string")).alias("txn_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("debit_account"), F.concat(F.lit("P"), F.left("o_orderpriority", F.lit(1))).alias("credit_account"),
        F.col("o_totalprice").alias("amount"), F.lit("EUR").alias("ccy"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value_date"), F.lit("order").alias("narrative"),
    ))


@query(
    "intake_comms",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events), side AS (SELECT event_id, n, 0 AS k, 'phone=' || lpad(CAST(user_id AS VARCHAR), 10, '7') AS value FROM e
         UNION ALL SELECT event_id, n, 1, 'email=u' || user_id || '@x.org' FROM e WHERE event_id % 4 > 0)
       SELECT 'person' AS kind, row_number() OVER (ORDER BY n, k) - 1 AS pos, 'comms:' || CASE k WHEN 0 THEN 'A' ELSE 'B' END || event_id AS key, value FROM side
       UNION ALL SELECT 'communicated', row_number() OVER (ORDER BY n) - 1, 'comms:V' || event_id, 'comms:A' || event_id || ';comms:B' || event_id || ';' || strftime(ts, '%Y-%m-%d') || ';channel=' || event_type FROM e WHERE event_id % 4 > 0""",
)
def intake_comms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth recipient has neither number nor address: no record, no link."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    side = lambda mark, number, mail: F.struct(F.concat(F.lit(mark), k.cast("string")).alias("selector_id"), number.alias("msisdn"), mail.alias("address"))
    none = F.lit(None).cast("string")
    return _taken_in(spark, "comms_metadata.jsonl", table(spark, sf_dir, "events").select(
        k.alias("ord"), F.concat(F.lit("V"), k.cast("string")).alias("event_id"), F.col("event_type").alias("channel"), side("A", F.concat(F.lit("+44 "), F.lpad(user, 10, "7")), none).alias("originator"),
        side("B", none, F.when(k % 4 > 0, F.concat(F.lit("U"), user, F.lit("@X.org")))).alias("recipient"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
    ))


@query(
    "intake_watchlist",
    """SELECT 'person' AS kind, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, 'watch:W' || s_suppkey AS key, 'full_name=william listed' || CASE WHEN s_suppkey % 2 = 0 THEN ';dob=1974-03-08' ELSE '' END || ';nationality=n' || s_nationkey AS value FROM supplier""",
)
def intake_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _taken_in(spark, "watchlist.csv", table(spark, sf_dir, "supplier").select(
        k.alias("ord"), F.concat(F.lit("W"), k.cast("string")).alias("listing_id"), F.lit("Bill  Listed Jr").alias("subject_name"), F.when(k % 2 == 0, F.lit("8 Mar 1974")).alias("date_of_birth"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nationality"), F.lit("sanctions").alias("category"), F.lit("2023-01-01").alias("listed_on"),
    ))


# --- the graph ---------------------------------------------------------------------------

_PERSON = EntityType("person", {"full_name": PropertyDef("full_name", "name", display=True), "segment": PropertyDef("segment"), "balance": PropertyDef("balance", "number")})
_ORG = EntityType("organization", {"legal_name": PropertyDef("legal_name", "org", display=True), "balance": PropertyDef("balance", "number")})
_PLACE = EntityType("location", {"address": PropertyDef("address", "address", display=True)})
_USER = EntityType("user", {"label": PropertyDef("label", "raw", display=True)})
TRADE = Ontology(
    "trade",
    {e.name: e for e in (_PERSON, _ORG, _PLACE, _USER)},
    {
        k.name: k
        for k in (
            LinkType("ordered", "person", "organization", 1.0),
            LinkType("registered_at", "organization", "location", 1.2),
            LinkType("resides_at", "person", "location", 0.8),
            LinkType("officer_of", "person", "organization", 1.4),
            LinkType("transacted", "user", "user", 1.0),
            LinkType("communicated", "user", "user", 0.9, symmetric=True),
        )
    },
)


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.col(key).cast("string"))


def _links(rows: DataFrame, link_type: str, start: Column, end: Column, ord_: Column, amount: Column | None = None, date: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(link_type).alias("link_type"), start.alias("source_key"), end.alias("target_key"), ord_.cast("long").alias("ord"), F.concat(F.lit(link_type + ":"), ord_.cast("string")).alias("link_key"),
        (F.lit(None) if amount is None else amount).cast("double").alias("amount"), (F.lit(None) if date is None else date).cast("string").alias("date"), F.create_map().cast("map<string,string>").alias("attrs"),
    )


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier links, one per line item."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return _links(items, "ordered", _id("C", "o_custkey"), _id("S", "l_suppkey"), ord_, F.col("l_extendedprice"), F.date_format("l_shipdate", "yyyy-MM-dd"))


def _keys(spark: SparkSession, sf_dir: str, every: int = 0) -> DataFrame:
    """Record keys and entity ids of customers and suppliers; each is its own entity."""
    suppliers = table(spark, sf_dir, "supplier")
    if every:
        suppliers = suppliers.where(F.col("s_suppkey") % every != 0)
    both = table(spark, sf_dir, "customer").select(_id("C", "c_custkey").alias("key")).unionByName(suppliers.select(_id("S", "s_suppkey").alias("key")))
    return both.withColumn("entity_id", F.col("key"))


def _flow_links(spark: SparkSession, sf_dir: str, link_type: str) -> DataFrame:
    """User to next user of the same event type."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id", "value")
    # numbered in order without a window over all events of a type; the next event has the next number
    numbered = number_rows(events, ["event_type", "ts", "event_id"], "n")
    after = numbered.select((F.col("n") - 1).alias("n"), F.col("event_type").alias("next_type"), F.col("user_id").alias("next"))
    pairs = numbered.join(after, "n").where("event_type = next_type AND next IS NOT NULL")
    return _links(pairs, link_type, _id("U", "user_id"), _id("U", "next"), F.col("event_id"), F.col("value"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    ident = _id("U", "user_id")
    return users.select(
        ident.alias("id"), F.lit("user").alias("entity_type"), F.col("user_id").alias("ord"), F.create_map(F.lit("label"), F.array(ident)).alias("props"),
        F.array(F.concat(F.lit("ev:"), F.col("user_id").cast("string"))).alias("members"), F.array(F.lit("ev")).alias("sources"), F.lit(0.7).alias("confidence"),
    )


def _flow_edges(spark: SparkSession, sf_dir: str, link_type: str = "transacted") -> DataFrame:
    keys = _users(spark, sf_dir).select(F.col("id").alias("key"), F.col("id").alias("entity_id"))
    return materialize(graph.build_edges(graph.rewire(_flow_links(spark, sf_dir, link_type), keys), TRADE), "flow-edges", compact=True)


_ORDERED_SQL = "ordered AS (SELECT 'C-' || o_custkey AS src, 'S-' || l_suppkey AS dst, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_FLOW_SQL = """flow AS (SELECT 'U-' || user_id AS src, 'U-' || lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst, value AS amount FROM events),
edges AS (SELECT src, dst, count(*) AS count, sum(amount) AS total FROM flow WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2)"""
_NEAR_SQL = f"{_FLOW_SQL}, near AS (SELECT src AS node, dst AS other, 'transacted|' || src || '|' || dst AS edge_id FROM edges UNION ALL SELECT dst, src, 'transacted|' || src || '|' || dst FROM edges)"


@query("rewire_edges", f"WITH {_ORDERED_SQL} SELECT 'ordered' AS link_type, src, dst, count(*) AS count, round(sum(amount), 2) AS total_amount FROM ordered GROUP BY 2, 3")
def rewire_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.build_edges(graph.rewire(_ordered(spark, sf_dir), _keys(spark, sf_dir)), TRADE)
    return edges.select("link_type", "src", "dst", "count", F.round("total_amount", 2).alias("total_amount"))


@query(
    "edge_provenance",
    """WITH o AS (SELECT 'C-' || o_custkey AS src, 'S-' || l_suppkey AS dst, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       k AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS n FROM o)
       SELECT src, dst, string_agg('ordered:' || ord, ',' ORDER BY ord) AS provenance FROM k WHERE n <= 25 GROUP BY 1, 2""",
)
def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.provenance(graph.observations(graph.rewire(_ordered(spark, sf_dir), _keys(spark, sf_dir)), TRADE))
    return found.select(F.split_part("edge_id", F.lit("|"), F.lit(2)).alias("src"), F.split_part("edge_id", F.lit("|"), F.lit(3)).alias("dst"), F.concat_ws(",", "provenance").alias("provenance"))


@query(
    "edge_dates",
    """SELECT 'C-' || o_custkey AS src, 'S-' || l_suppkey AS dst, string_agg(strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY l_shipdate) AS dates
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def edge_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = graph.observations(graph.rewire(_ordered(spark, sf_dir), _keys(spark, sf_dir)), TRADE)
    return graph.edge_dates(seen).select(F.split_part("id", F.lit("|"), F.lit(2)).alias("src"), F.split_part("id", F.lit("|"), F.lit(3)).alias("dst"), F.concat_ws(",", "dates").alias("dates"))


@query("dangling_links", "SELECT 'ordered:' || (l_orderkey * 10 + l_linenumber) AS link_key FROM lineitem WHERE l_suppkey % 10 = 0")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling_links(graph.rewire(_ordered(spark, sf_dir), _keys(spark, sf_dir, 10)), TRADE).select("link_key")


@query("symmetric_edges", f"WITH {_FLOW_SQL} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(count) AS BIGINT) AS count FROM edges GROUP BY 1, 2")
def symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_edges(spark, sf_dir, "communicated").select("src", "dst", "count")


@query("degree", f"WITH {_FLOW_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_flow_edges(spark, sf_dir))


@query(
    "degree_centrality",
    f"""WITH {_FLOW_SQL}, u AS (SELECT DISTINCT 'U-' || user_id AS node FROM events), d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
        SELECT u.node, round(coalesce(d.n, 0) / CAST((SELECT greatest(1, count(*) - 1) FROM u) AS DOUBLE), 6) AS centrality FROM u LEFT JOIN d USING (node)""",
)
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degree_centrality(_users(spark, sf_dir), _flow_edges(spark, sf_dir)).select("node", F.round("centrality", 6).alias("centrality"))


@query(
    "graph_stats",
    f"""WITH {_FLOW_SQL} SELECT 'entity' AS section, 'user' AS name, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'edge', 'transacted', count(*) FROM edges
        UNION ALL SELECT 'total', 'observations', CAST(sum(count) AS BIGINT) FROM edges""",
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(_users(spark, sf_dir), _flow_edges(spark, sf_dir))


@query(
    "graph_round_trip",
    f"""WITH {_FLOW_SQL} SELECT 'entity' AS section, 'user' AS name, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'edge', 'transacted', count(*) FROM edges
        UNION ALL SELECT 'total', 'observations', CAST(sum(count) AS BIGINT) FROM edges UNION ALL SELECT 'total', 'dangling_links', 7
        UNION ALL SELECT 'export', 'provenance', CAST(sum(least(count, 25)) AS BIGINT) FROM edges UNION ALL SELECT 'export', 'label', count(DISTINCT user_id) FROM events""",
)
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph saved, loaded again and counted; and what its JSON export holds."""
    users, folder = _users(spark, sf_dir), scratch_path(spark, "graph")
    wired = graph.rewire(_flow_links(spark, sf_dir, "transacted"), users.select(F.col("id").alias("key"), F.col("id").alias("entity_id")))
    seen = materialize(graph.observations(wired, TRADE), "observations")
    graph.KnowledgeGraph(TRADE, users, graph.fold(seen), 7, seen).save(folder)
    again = graph.KnowledgeGraph.load(spark, folder, TRADE)
    edges = spark.read.schema("id string, provenance array<string>").json(f"{folder}/json/edges")
    entities = spark.read.schema("id string, label string").json(f"{folder}/json/entities")
    line = lambda frame, name, n: frame.agg(n.alias("n")).select(F.lit("export").alias("section"), F.lit(name).alias("name"), "n")
    counted = graph.graph_stats(again.entities, again.edges, again.dangling)
    return counted.unionByName(line(edges, "provenance", F.sum(F.size("provenance")))).unionByName(line(entities, "label", F.count("label")))


@query("community_sizes", "SELECT CAST(user_id % 5 AS VARCHAR) AS community, count(DISTINCT user_id) AS size FROM events GROUP BY 1")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.community_sizes(_users(spark, sf_dir).select(F.col("id").alias("node"), (F.col("ord") % 5).cast("string").alias("community")))


@query("neighbours_out", f"WITH {_FLOW_SQL} SELECT dst AS other, count FROM edges WHERE src = 'U-1'")
def neighbours_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_flow_edges(spark, sf_dir), "U-1", ["transacted"], "out").select("other", "count")


@query("subgraph_edges", f"WITH {_FLOW_SQL} SELECT src, dst, count FROM edges WHERE CAST(substr(src, 3) AS BIGINT) < 20 AND CAST(substr(dst, 3) AS BIGINT) < 20")
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _users(spark, sf_dir).where("ord < 20").select(F.col("id").alias("node"))
    return graph.subgraph_edges(_flow_edges(spark, sf_dir), nodes).select("src", "dst", "count")


@query(
    "ego_2hop",
    f"""WITH {_NEAR_SQL}, h1 AS (SELECT DISTINCT other AS node FROM near WHERE node = 'U-1' AND other <> 'U-1'),
        h2 AS (SELECT DISTINCT other AS node FROM near WHERE node IN (SELECT node FROM h1) AND other <> 'U-1' AND other NOT IN (SELECT node FROM h1))
        SELECT 'U-1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
)
def ego_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.ego(_flow_edges(spark, sf_dir), "U-1", 2)


_PATHS_SQL = f"""WITH RECURSIVE {_NEAR_SQL}, walk(node, path, edge_ids) AS (SELECT 'U-1', ['U-1'], CAST([] AS VARCHAR[]) UNION ALL
  SELECT n.other, list_append(w.path, n.other), list_append(w.edge_ids, n.edge_id) FROM walk w JOIN near n ON n.node = w.node WHERE w.node <> 'U-7' AND len(w.edge_ids) < 3 AND NOT list_contains(w.path, n.other))"""


@query(
    "shortest_path",
    f"{_PATHS_SQL} SELECT min(len(edge_ids)) AS hops FROM walk WHERE node = 'U-7'",
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.shortest_path(_flow_edges(spark, sf_dir), "U-1", "U-7", 3).agg(F.max("step").cast("long").alias("hops"))


@query("all_paths_3hop", f"{_PATHS_SQL} SELECT len(edge_ids) AS hops, array_to_string(path, '>') AS path, array_to_string(edge_ids, ' ') AS edge_ids FROM walk WHERE node = 'U-7'")
def all_paths_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traversal.all_paths(_flow_edges(spark, sf_dir), "U-1", "U-7", 3, None)
    return found.select(F.col("hops").cast("long").alias("hops"), F.concat_ws(">", "path").alias("path"), F.concat_ws(" ", "edge_ids").alias("edge_ids"))


_FLOW_ENDS = "SELECT src AS node, dst AS other, 1.0 + ln(1 + count) AS w FROM edges UNION ALL SELECT dst, src, 1.0 + ln(1 + count) FROM edges"


def _rank_steps(nodes: str, ends: str, restart: str, rounds: int) -> str:
    steps = ["r0 AS (SELECT node, restart AS rank FROM start)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS (SELECT s.node, s.restart * (0.15 + 0.85 * (SELECT coalesce(sum(r.rank), 0) FROM r{k - 1} r JOIN start t USING (node) WHERE t.sink)) + 0.85 * coalesce(g.got, 0) AS rank "
            f"FROM start s LEFT JOIN (SELECT w.other AS node, sum(r.rank * w.share) AS got FROM r{k - 1} r JOIN w USING (node) GROUP BY 1) g USING (node))"
        )
    return f"""u AS ({nodes}), ends AS ({ends}), w AS (SELECT node, other, sum(w) / sum(sum(w)) OVER (PARTITION BY node) AS share FROM ends GROUP BY 1, 2),
      start AS (SELECT node, CAST({restart} AS DOUBLE) AS restart, node NOT IN (SELECT node FROM w) AS sink FROM u), {", ".join(steps)}"""


def _rank_sql(restart: str, rounds: int = 10) -> str:
    return f"WITH {_FLOW_SQL}, {_rank_steps("SELECT DISTINCT 'U-' || user_id AS node FROM events", _FLOW_ENDS, restart, rounds)} SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query("pagerank_uniform_10", _rank_sql("1.0 / (SELECT count(*) FROM u)"))
def pagerank_uniform_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pagerank(_users(spark, sf_dir), _flow_edges(spark, sf_dir), TRADE, None, 0.85, 10, None).select("node", F.round("rank", 6).alias("rank"))


@query("pagerank_seeded_10", _rank_sql("CASE WHEN node IN ('U-1', 'U-2') THEN 0.5 ELSE 0.0 END"))
def pagerank_seeded_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("U-1",), ("U-2",)], "node string")
    return analytics.pagerank(_users(spark, sf_dir), _flow_edges(spark, sf_dir), TRADE, seeds, 0.85, 10, None).select("node", F.round("rank", 6).alias("rank"))


@query(
    "modularity",
    f"""WITH {_FLOW_SQL}, e AS (SELECT CAST(substr(src, 3) AS BIGINT) % 5 AS a, CAST(substr(dst, 3) AS BIGINT) % 5 AS b FROM edges), m AS (SELECT count(*) AS m FROM e),
        d AS (SELECT c, count(*) AS d FROM (SELECT a AS c FROM e UNION ALL SELECT b FROM e) GROUP BY 1), i AS (SELECT a AS c, count(*) AS i FROM e WHERE a = b GROUP BY 1)
        SELECT round(sum(coalesce(i.i, 0) / CAST(m.m AS DOUBLE) - pow(d.d / (2.0 * m.m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c), m""",
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _users(spark, sf_dir).select(F.col("id").alias("node"), (F.col("ord") % 5).cast("string").alias("community"))
    return analytics.modularity(_flow_edges(spark, sf_dir), labels).select(F.round("modularity", 6).alias("modularity"))


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.communities(_users(spark, sf_dir), _flow_edges(spark, sf_dir), TRADE)


_LEVELS_SQL = 7  # more than the longest shortest path of the tables
_BETWEEN_SQL = f"""WITH RECURSIVE {_NEAR_SQL}, u AS (SELECT DISTINCT 'U-' || user_id AS node FROM events), ways AS (SELECT node, other, count(*) AS m FROM near GROUP BY 1, 2),
  walk(s, node, d) AS (SELECT node, node, 0 UNION SELECT w.s, y.other, w.d + 1 FROM walk w JOIN ways y USING (node) WHERE w.d < {_LEVELS_SQL}),
  dist AS (SELECT s, node, min(d) AS d FROM walk GROUP BY 1, 2), n0 AS (SELECT s, node, CAST(1.0 AS DOUBLE) AS sigma FROM dist WHERE d = 0)"""
_BETWEEN_SQL = _BETWEEN_SQL.replace("(SELECT node, node, 0 UNION", "(SELECT node, node, 0 FROM u UNION")
for _k in range(1, _LEVELS_SQL + 1):
    _BETWEEN_SQL += f", n{_k} AS (SELECT p.s, y.other AS node, sum(p.sigma * y.m) AS sigma FROM n{_k - 1} p JOIN ways y USING (node) JOIN dist t ON t.s = p.s AND t.node = y.other AND t.d = {_k} GROUP BY 1, 2)"
_BETWEEN_SQL += ", paths AS (" + " UNION ALL ".join(f"SELECT s, node, {_k} AS d, sigma FROM n{_k}" for _k in range(_LEVELS_SQL + 1)) + ")"
_BETWEEN_SQL += """, share AS (SELECT a.node, sum(a.sigma * b.sigma / c.sigma) AS b FROM paths a JOIN paths b ON b.s = a.node JOIN paths c ON c.s = a.s AND c.node = b.node AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY 1)
  SELECT u.node, round(coalesce(share.b, 0) / ((SELECT count(*) FROM u) - 1.0) / ((SELECT count(*) FROM u) - 2.0), 6) AS betweenness FROM u LEFT JOIN share USING (node)"""


@query("betweenness", _BETWEEN_SQL)
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.betweenness(_users(spark, sf_dir), _flow_edges(spark, sf_dir)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query(
    "weighted_pairs",
    f"WITH {_FLOW_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(1.0 + ln(1 + count)), 6) AS w FROM edges GROUP BY 1, 2",
)
def weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weighted_pairs(_flow_edges(spark, sf_dir), TRADE).select("a", "b", F.round("w", 6).alias("w"))


# --- patterns, risk, cases ---------------------------------------------------------------


@query(
    "circular_flows",
    f"""WITH RECURSIVE {_FLOW_SQL}, e AS (SELECT src, dst, total FROM edges WHERE count >= 3),
        p(start, node, path, total) AS (SELECT src, dst, [src, dst], total FROM e WHERE dst > src UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst), p.total + e.total
          FROM p JOIN e ON e.src = p.node WHERE len(p.path) < 8 AND e.dst > p.start AND NOT list_contains(p.path, e.dst)),
        c AS (SELECT list_sort(p.path) AS nodes, array_to_string(p.path, '>') AS path, p.total + e.total AS total FROM p JOIN e ON e.src = p.node AND e.dst = p.start WHERE len(p.path) >= 3)
        SELECT min(path) AS path, round(arg_min(total, path), 2) AS total_amount, round(CAST(least(1.0, 0.55 + 0.08 * len(nodes)) AS DOUBLE), 6) AS severity FROM c GROUP BY nodes""",
)
def circular_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = typologies.circular_flows(_flow_edges(spark, sf_dir), limit=None)
    return found.select(F.concat_ws(">", "entities").alias("path"), F.element_at("evidence", "total_amount").cast("double").alias("total_amount"), F.round("severity", 6).alias("severity"))


@query(
    "structuring",
    """WITH o AS (SELECT 'C-' || o_custkey AS src, o_totalprice AS amount, o_totalprice >= 100000 AND o_totalprice < 200000 AS hit FROM orders),
       g AS (SELECT src, count(*) FILTER (WHERE hit) AS hits, count(*) AS outgoing, count(*) FILTER (WHERE amount >= 200000) AS above, min(amount) FILTER (WHERE hit) AS least, max(amount) FILTER (WHERE hit) AS most FROM o GROUP BY 1)
       SELECT src, hits, outgoing, above, round(least, 2) AS least, round(most, 2) AS most, round(CAST(least(1.0, 0.4 + 0.6 * hits / outgoing) AS DOUBLE), 6) AS severity FROM g WHERE hits >= 4 AND hits / CAST(outgoing AS DOUBLE) >= 0.35""",
)
def structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    links = _links(orders, "transacted", _id("C", "o_custkey"), _id("P", "o_orderpriority"), F.col("o_orderkey"), F.col("o_totalprice"))
    keys = orders.select(F.explode(F.array(_id("C", "o_custkey"), _id("P", "o_orderpriority"))).alias("key")).distinct().withColumn("entity_id", F.col("key"))
    found = typologies.structuring(graph.observations(graph.rewire(links, keys), TRADE), threshold=200_000.0, band=0.5, min_count=4, limit=None)
    fact = lambda k, kind: F.element_at("evidence", k).cast(kind)
    return found.select(
        F.element_at("entities", 1).alias("src"), fact("count", "long").alias("hits"), fact("outgoing", "long").alias("outgoing"), fact("above", "long").alias("above"),
        fact("min", "double").alias("least"), fact("max", "double").alias("most"), F.round("severity", 6).alias("severity"),
    )


def _trade_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people, suppliers as organizations, nations as places."""

    def made(rows: DataFrame, prefix: str, key: str, kind: str, source: str, **props: str) -> DataFrame:
        facts = [x for k, v in props.items() for x in (F.lit(k), F.array(F.col(v).cast("string")))]
        ident = _id(prefix, key)
        return rows.select(
            ident.alias("id"), F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("ord"), F.create_map(*facts).alias("props"),
            F.array(F.concat(F.lit(source + ":"), F.col(key).cast("string"))).alias("members"), F.array(F.lit(source)).alias("sources"), F.lit(0.7).alias("confidence"),
        )

    people = made(table(spark, sf_dir, "customer"), "C", "c_custkey", "person", "crm", full_name="c_name", segment="c_mktsegment", balance="c_acctbal")
    orgs = made(table(spark, sf_dir, "supplier"), "S", "s_suppkey", "organization", "erp", legal_name="s_name", balance="s_acctbal")
    places = made(table(spark, sf_dir, "nation"), "N", "n_nationkey", "location", "geo", address="n_name")
    return people.unionByName(orgs).unionByName(places)


def _trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers registered in nations; customers officers of the suppliers they ordered from three times or more."""
    suppliers = table(spark, sf_dir, "supplier")
    at = _links(suppliers, "registered_at", _id("S", "s_suppkey"), _id("N", "s_nationkey"), F.col("s_suppkey"))
    often = _ordered(spark, sf_dir).groupBy("source_key", "target_key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).where("n >= 3")
    boards = _links(often, "officer_of", F.col("source_key"), F.col("target_key"), F.col("ord"))
    keys = _trade_entities(spark, sf_dir).select(F.col("id").alias("key"), F.col("id").alias("entity_id"))
    return materialize(graph.build_edges(graph.rewire(at.unionByName(boards), keys), TRADE), "trade-edges", compact=True)


_OFTEN_SQL = f"{_ORDERED_SQL}, boards AS (SELECT src AS officer, dst AS org FROM ordered GROUP BY 1, 2 HAVING count(*) >= 3), seats AS (SELECT 'S-' || s_suppkey AS org, 'N-' || s_nationkey AS place FROM supplier)"


@query(
    "shared_registration",
    f"""WITH {_OFTEN_SQL}, n AS (SELECT place, count(*) AS companies, string_agg(org, ',' ORDER BY org) AS orgs FROM seats GROUP BY 1 HAVING count(*) >= 3),
        k AS (SELECT place, count(*) AS officers FROM (SELECT place, officer FROM seats JOIN boards USING (org) GROUP BY 1, 2 HAVING count(DISTINCT org) > 1) GROUP BY 1)
        SELECT n.place, orgs, companies, coalesce(officers, 0) AS officers, round(CAST(least(1.0, 0.3 + 0.1 * companies + 0.12 * coalesce(officers, 0)) AS DOUBLE), 6) AS severity FROM n LEFT JOIN k USING (place)""",
)
def shared_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = typologies.shared_registration(_trade_entities(spark, sf_dir), _trade_edges(spark, sf_dir), limit=None)
    officers = F.size(F.filter(F.split(F.element_at("evidence", "shared_officers"), ","), lambda x: x != ""))
    return found.select(
        F.element_at("entities", 1).alias("place"), F.element_at("evidence", "companies").alias("orgs"), (F.size("entities") - 1).cast("long").alias("companies"), officers.cast("long").alias("officers"), F.round("severity", 6).alias("severity")
    )


_DATES_SQL = "dates AS (SELECT 'S-' || l_suppkey AS org, CAST(min(l_shipdate) AS DATE) AS incorporated FROM lineitem GROUP BY 1)"


def _first_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(_id("S", "l_suppkey").alias("org")).agg(F.to_date(F.min("l_shipdate")).alias("incorporated"))


@query(
    "rapid_incorporation_pairs",
    f"""WITH {_OFTEN_SQL}, {_DATES_SQL}, held AS (SELECT officer, org, incorporated FROM boards JOIN dates USING (org))
        SELECT DISTINCT x.org AS a, y.org AS b, x.officer FROM held x JOIN held y ON x.officer = y.officer AND x.org < y.org AND abs(date_diff('day', x.incorporated, y.incorporated)) <= 90""",
)
def rapid_incorporation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typologies.close_pairs(_trade_edges(spark, sf_dir), _first_shipments(spark, sf_dir), 90)


@query(
    "rapid_incorporation",
    f"""WITH RECURSIVE {_OFTEN_SQL}, {_DATES_SQL}, held AS (SELECT officer, org, incorporated FROM boards JOIN dates USING (org)),
        pairs AS (SELECT DISTINCT x.org AS a, y.org AS b, x.officer FROM held x JOIN held y ON x.officer = y.officer AND x.org < y.org AND abs(date_diff('day', x.incorporated, y.incorporated)) <= 90),
        m AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT DISTINCT a, a FROM m UNION SELECT reach.a, m.b FROM reach JOIN m ON m.a = reach.b),
        part AS (SELECT a AS org, min(b) AS component FROM reach GROUP BY 1),
        g AS (SELECT component, string_agg(org, ',' ORDER BY org) AS companies, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3),
        o AS (SELECT component, count(DISTINCT officer) AS k FROM pairs JOIN part ON part.org = pairs.a GROUP BY 1)
        SELECT companies, n, k, round(CAST(least(1.0, 0.45 + 0.1 * n + 0.1 * k) AS DOUBLE), 6) AS severity FROM g JOIN o USING (component)""",
)
def rapid_incorporation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = typologies.rapid_incorporation(_trade_entities(spark, sf_dir), _trade_edges(spark, sf_dir), limit=None, dates=_first_shipments(spark, sf_dir))
    count = lambda k: F.size(F.split(F.element_at("evidence", k), ",")).cast("long")
    return found.select(F.element_at("evidence", "companies").alias("companies"), count("companies").alias("n"), count("officers").alias("k"), F.round("severity", 6).alias("severity"))


@query("principals", f"WITH {_OFTEN_SQL} SELECT org AS node, officer AS principal, 1 AS hops FROM boards")
def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.principals(_trade_entities(spark, sf_dir), _trade_edges(spark, sf_dir))


@query(
    "principals_two_hops",
    f"""WITH {_OFTEN_SQL}, held AS (SELECT 'A-' || s_nationkey AS node, 'S-' || s_suppkey AS org FROM supplier)
        SELECT node, principal, min(hops) AS hops FROM (SELECT node, org AS principal, 1 AS hops FROM held UNION ALL SELECT node, officer, 2 FROM held JOIN boards USING (org) UNION ALL SELECT org, officer, 1 FROM boards) GROUP BY 1, 2""",
)
def principals_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts (one a nation) lead to the companies that control them and on to their officers."""
    suppliers = table(spark, sf_dir, "supplier")
    held = suppliers.select(F.lit("controls_account").alias("link_type"), _id("S", "s_suppkey").alias("src"), _id("A", "s_nationkey").alias("dst")).distinct()
    edges = _trade_edges(spark, sf_dir).select("link_type", "src", "dst").unionByName(held)
    return risk.principals(_trade_entities(spark, sf_dir), edges)


def _attributed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    entities, edges = _trade_entities(spark, sf_dir), _trade_edges(spark, sf_dir)
    findings = typologies.shared_registration(entities, edges, limit=None)
    return entities, edges, findings, risk.attribute(entities, edges, findings)


@query(
    "attribute_findings",
    f"""WITH {_OFTEN_SQL}, n AS (SELECT place FROM seats GROUP BY 1 HAVING count(*) >= 3), core AS (SELECT 'shared_registration:' || place AS finding_id, place AS entity_id FROM n
        UNION SELECT 'shared_registration:' || place, org FROM seats WHERE place IN (SELECT place FROM n))
        SELECT finding_id, entity_id, 0 AS hops FROM core UNION ALL SELECT DISTINCT finding_id, officer, 1 FROM core JOIN boards ON boards.org = core.entity_id""",
)
def attribute_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir)[3]


_CLEAR_SQL = f"""{_OFTEN_SQL}, n AS (SELECT place, count(*) AS companies FROM seats GROUP BY 1 HAVING count(*) >= 3),
        k AS (SELECT place, count(*) AS officers FROM (SELECT place, officer FROM seats JOIN boards USING (org) GROUP BY 1, 2 HAVING count(DISTINCT org) > 1) GROUP BY 1),
        f AS (SELECT place, least(1.0, 0.3 + 0.1 * companies + 0.12 * coalesce(officers, 0)) AS severity FROM n LEFT JOIN k USING (place)),
        hits AS (SELECT place AS entity_id, severity, 0 AS hops FROM f UNION ALL SELECT org, severity, 0 FROM f JOIN seats USING (place) UNION ALL SELECT DISTINCT ON (f.place, officer) officer, severity, 1 FROM f JOIN seats USING (place) JOIN boards USING (org)),
        clear AS (SELECT entity_id, product(1 - 0.45 * severity / (1 + hops)) AS clear FROM hits GROUP BY 1),
        ids AS (SELECT 'C-' || c_custkey AS entity_id FROM customer UNION ALL SELECT 'S-' || s_suppkey FROM supplier UNION ALL SELECT 'N-' || n_nationkey FROM nation)"""


def _equal_risk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entities, and their risk where all are equally close to the seeds (.6)."""
    entities, _, findings, attributed = _attributed(spark, sf_dir)
    flat = entities.select(F.col("id").alias("node"), F.lit(0.001).alias("rank"))
    return entities, risk.risk_scores(entities, flat, findings, attributed)


@query("risk_scores", f"WITH {_CLEAR_SQL} SELECT entity_id, round(1 - (1 - 0.6) * coalesce(clear, 1.0), 6) AS risk FROM ids LEFT JOIN clear USING (entity_id)")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _equal_risk(spark, sf_dir)[1].select("entity_id", F.round("risk", 6).alias("risk"))


_TRADE_ENDS = f"""SELECT a AS node, b AS other, w FROM (SELECT org AS a, place AS b, 1.2 * (1 + ln(2)) AS w FROM seats UNION ALL SELECT place, org, 1.2 * (1 + ln(2)) FROM seats
  UNION ALL SELECT officer, org, 1.4 * (1 + ln(2)) FROM boards UNION ALL SELECT org, officer, 1.4 * (1 + ln(2)) FROM boards)"""


@query(
    "risk_from_pagerank",
    f"""WITH {_CLEAR_SQL}, {_rank_steps("SELECT entity_id AS node FROM ids", _TRADE_ENDS, "CASE WHEN node IN ('S-1', 'N-3') THEN 0.5 ELSE 0.0 END", 6)},
        top AS (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY rank DESC) - 1 AS k FROM r6) WHERE k = (SELECT count(*) // 100 FROM r6))
        SELECT entity_id, round(1 - (1 - 0.6 * least(1.0, rank / (SELECT rank FROM top))) * coalesce(clear, 1.0), 5) AS risk FROM r6 JOIN ids ON entity_id = node LEFT JOIN clear USING (entity_id)""",
)
def risk_from_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk whose closeness is a seeded PageRank, relative to the rank at the top hundredth."""
    entities, edges, findings, attributed = _attributed(spark, sf_dir)
    seeds = spark.createDataFrame([("S-1",), ("N-3",)], "node string")
    near = analytics.pagerank(entities, edges, TRADE, seeds, 0.85, 6, None)
    return risk.risk_scores(entities, near, findings, attributed).select("entity_id", F.round("risk", 5).alias("risk"))


@query(
    "top_risk",
    f"WITH {_CLEAR_SQL} SELECT entity_id AS id, round(1 - (1 - 0.6) * coalesce(clear, 1.0), 6) AS risk FROM ids LEFT JOIN clear USING (entity_id) WHERE entity_id LIKE 'S-%' ORDER BY 2 DESC, 1 LIMIT 15",
)
def top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen organizations of highest risk."""
    entities, scores = _equal_risk(spark, sf_dir)
    some = graph.of_type(entities, "organization").select(F.col("id").alias("entity_id")).join(scores, "entity_id")
    return some.select(F.col("entity_id").alias("id"), F.round("risk", 6).alias("risk")).orderBy(F.desc("risk"), "id").limit(15)


@query("top_findings", f"WITH {_CLEAR_SQL} SELECT 'shared_registration:' || place AS finding_id, round(CAST(severity AS DOUBLE), 6) AS severity FROM f ORDER BY 2 DESC, 1 LIMIT 20")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one pattern as its own limit leaves them, the most severe first."""
    found = typologies.shared_registration(_trade_entities(spark, sf_dir), _trade_edges(spark, sf_dir))
    return found.select("finding_id", F.round("severity", 6).alias("severity"))


@query(
    "entity_flags",
    f"""WITH {_CLEAR_SQL}, r AS (SELECT entity_id, round(1 - (1 - 0.6) * coalesce(clear, 1.0) - 0.3, 6) AS risk FROM ids LEFT JOIN clear USING (entity_id)),
        marks AS (SELECT entity_id, string_agg(DISTINCT id, ',' ORDER BY id) AS typologies FROM (SELECT place AS entity_id, 'shared_registration:' || place AS id FROM f UNION ALL SELECT org, 'shared_registration:' || place FROM f JOIN seats USING (place)) GROUP BY 1)
        SELECT entity_id, CASE WHEN entity_id IN ('S-1', 'C-2') THEN 'true' END AS watchlisted, CASE WHEN risk >= 0.5 THEN round(risk, 3) END AS risk, typologies FROM r LEFT JOIN marks USING (entity_id)""",
)
def entity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of listed entities, of risk of one half or more and of the findings that entities are in."""
    entities, _, findings, attributed = _attributed(spark, sf_dir)
    flat = entities.select(F.col("id").alias("node"), F.lit(0.001).alias("rank"))
    scores = materialize(risk.risk_scores(entities, flat, findings, attributed).withColumn("risk", F.round(F.col("risk") - 0.3, 6)), "risk")
    flags = pipeline.entity_flags(entities, spark.createDataFrame([("S-1",), ("C-2",)], "node string"), scores, attributed)
    of = lambda name: F.try_element_at("flags", F.lit(name))
    return flags.select("entity_id", of("watchlisted").alias("watchlisted"), of("risk").cast("double").alias("risk"), of("typologies").alias("typologies"))


@query("correlate_cases")
def correlate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges, findings, attributed = _attributed(spark, sf_dir)
    more = findings.unionByName(typologies.rapid_incorporation(entities, edges, dates=_first_shipments(spark, sf_dir)))
    flat = entities.select(F.col("id").alias("entity_id"), F.lit(0.6).alias("risk"))
    return risk.correlate_frame(risk.with_attribution(more, risk.attribute(entities, edges, more)), flat, entities).select(
        "case_id", F.concat_ws(",", "kinds").alias("kinds"), F.concat_ws(",", "findings").alias("findings"), F.size("entities").alias("entities"), "score"
    )


# --- the query language ------------------------------------------------------------------


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(graph.KnowledgeGraph(TRADE, _trade_entities(spark, sf_dir), _trade_edges(spark, sf_dir)))


_PEOPLE_SQL = "(SELECT 'C-' || c_custkey AS id, c_custkey AS ord, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer)"


def _language(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir).query(text).select("id")

    query(name, sql)(run)


_language("find_where_eq", "find person where segment = 'building' limit all", f"SELECT id FROM {_PEOPLE_SQL} WHERE lower(segment) = 'building'")
_language("find_where_ne", "find person where segment != building limit all", f"SELECT id FROM {_PEOPLE_SQL} WHERE lower(segment) <> 'building'")
_language("find_where_gt", "find person where balance > 5000 limit all", f"SELECT id FROM {_PEOPLE_SQL} WHERE balance > 5000")
_language("find_where_le", "find person where balance <= -100.5 limit all", f"SELECT id FROM {_PEOPLE_SQL} WHERE balance <= -100.5")
_language("find_where_contains", "find person where full_name ~ '00012' limit all", f"SELECT id FROM {_PEOPLE_SQL} WHERE contains(name, '00012')")
_language("find_where_missing", "find where segment != building limit all", f"SELECT id FROM {_PEOPLE_SQL} WHERE lower(segment) <> 'building' UNION ALL SELECT 'S-' || s_suppkey FROM supplier UNION ALL SELECT 'N-' || n_nationkey FROM nation")
_language(
    "find_where_boolean", "find person where not segment = building and (balance >= 9000 or balance < 0) limit all",
    f"SELECT id FROM {_PEOPLE_SQL} WHERE NOT lower(segment) = 'building' AND (balance >= 9000 OR balance < 0)",
)
_language("find_order_limit", "find person order by balance desc limit 10", f"SELECT id FROM {_PEOPLE_SQL} ORDER BY balance DESC, ord LIMIT 10")
_language("find_order_asc", "find organization order by balance asc limit 7", "SELECT 'S-' || s_suppkey AS id FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7")
_language(
    "find_where_degree", "find location where degree >= 4 limit all",
    "SELECT 'N-' || s_nationkey AS id FROM supplier GROUP BY 1 HAVING count(*) >= 4",
)
_language(
    "find_linked_via_within", "find organization linked to 'N-1' via registered_at within 1 limit all",
    "SELECT 'S-' || s_suppkey AS id FROM supplier WHERE s_nationkey = 1",
)
_language("show_query", "show S-3", "SELECT 'S-' || s_suppkey AS id FROM supplier WHERE s_suppkey = 3")


def _asked(name: str, question: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return NaturalLanguage(TRADE).ask(_engine(spark, sf_dir), question)[1].select("id")

    query(name, sql)(run)


_asked("ask_who", "Who is Customer#000000012?", "SELECT 'C-12' AS id")
_asked("ask_connected", "What is connected to N-1?", "SELECT 'S-' || s_suppkey AS id FROM supplier WHERE s_nationkey = 1 ORDER BY s_suppkey LIMIT 25")
_asked("ask_top", "top 4 risky companies", "SELECT 'S-' || s_suppkey AS id FROM supplier ORDER BY s_suppkey LIMIT 4")


@query("path_query", f"{_PATHS_SQL} SELECT len(edge_ids) AS hops, array_to_string(path, '>') AS path FROM walk WHERE node = 'U-7' ORDER BY 1, path LIMIT 5")
def path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(graph.KnowledgeGraph(TRADE, _users(spark, sf_dir), _flow_edges(spark, sf_dir)))
    return engine.query("path U-1 to U-7 within 3 limit 5").select(F.col("hops").cast("long").alias("hops"), F.concat_ws(">", "path").alias("path"))


@query("search_text", f"SELECT id FROM {_PEOPLE_SQL} WHERE contains(lower(name), '#00000012') ORDER BY ord LIMIT 20")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(_trade_entities(spark, sf_dir).where("entity_type = 'person'"), "#00000012", 20).select("id")


@query("find_by_property", f"SELECT id FROM {_PEOPLE_SQL} WHERE segment = 'MACHINERY'")
def find_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find(_trade_entities(spark, sf_dir), "person", segment="MACHINERY").select("id")


@query("entity_labels", "SELECT 'S-' || s_suppkey AS id, s_name AS label FROM supplier UNION ALL SELECT 'C-' || c_custkey, c_name FROM customer UNION ALL SELECT 'N-' || n_nationkey, n_name FROM nation")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_entities(spark, sf_dir).select("id", graph.label().alias("label"))


@query("dossier_provenance", "SELECT 'crm' AS source, count(*) AS records FROM customer UNION ALL SELECT 'erp', count(*) FROM supplier UNION ALL SELECT 'geo', count(*) FROM nation")
def dossier_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.investigate import provenance

    return provenance(_trade_entities(spark, sf_dir))
