"""SQL functions of a session: what clients call by name, over temporary views.

    register(spark, notices=..., categories=..., synonyms=..., embeddings=..., events=...)
    spark.sql("SELECT * FROM notice_search('high', 20)")

Table functions: notice_search, synonym_search, semantic_search, popular_regions, popular_keywords. Scalar functions: url_host,
engagement, popularity. Each has a body in SQL, so that Catalyst sees through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.operators.search import DEFAULT_LIMIT, MOST
from noticeloom.plans import search
from noticeloom.sources.tables import EVENTS_NOW, ORDERS_NOW, table

_MOST = f"least({MOST}, greatest(1, coalesce(most, {DEFAULT_LIMIT})))"
# the literal bound comes first, so that rows are numbered among these few only
_RANKED = "SELECT {{out}} FROM (SELECT *, row_number() OVER (ORDER BY {{order}}) AS place FROM (SELECT * FROM ({{rows}}) ORDER BY {{order}} LIMIT {})) WHERE place <= {{most}} ORDER BY place".format(MOST)
# the term as a pattern, % and _ keep their meaning; a blank one fits everything
_FITS = "(trim(coalesce(query, '')) = '' OR title ILIKE concat('%', trim(query), '%') OR org ILIKE concat('%', trim(query), '%'))"
_TERMS = "SELECT collect_set(term) FROM (SELECT lower(trim(query)) AS term UNION ALL SELECT lower(synonym) FROM fn_synonyms WHERE lower(word) = lower(trim(query)) UNION ALL SELECT lower(word) FROM fn_synonyms WHERE lower(synonym) = lower(trim(query)))"
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
_COSINE = f"greatest(0D, {_DOT.format(a='embedding', b='vector')} / nullif(sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='vector', b='vector')}), 0D))"
FUNCTIONS = {
    "notice_search(query STRING, most INT)": "TABLE(id BIGINT, title STRING, end_at TIMESTAMP_NTZ)",
    "synonym_search(query STRING, most INT)": "TABLE(id BIGINT, title STRING, end_at TIMESTAMP_NTZ)",
    "semantic_search(vector ARRAY<DOUBLE>, least DOUBLE, most INT)": "TABLE(id BIGINT, similarity DOUBLE)",
    "popular_regions(most INT)": "TABLE(region INT, n BIGINT)",
    "popular_keywords(days INT, most INT)": "TABLE(keyword STRING, searches BIGINT)",
    "url_host(url STRING)": "STRING",
    "engagement(views DOUBLE, clicks DOUBLE, favorites DOUBLE)": "DOUBLE",
    "popularity(views DOUBLE, clicks DOUBLE, favorites DOUBLE)": "DOUBLE",
}
_BODIES = {
    "notice_search": _RANKED.format(out="id, title, end_at", order="end_at ASC NULLS LAST, id", most=_MOST, rows=f"SELECT * FROM fn_notices WHERE {_FITS} AND (end_at IS NULL OR end_at >= TIMESTAMP_NTZ '{ORDERS_NOW}')"),
    "synonym_search": _RANKED.format(out="id, title, end_at", order="end_at DESC NULLS LAST, id", most=_MOST, rows=f"SELECT n.* FROM fn_notices n CROSS JOIN ({_TERMS.replace('collect_set(term)', 'collect_set(term) AS terms')}) WHERE exists(terms, t -> contains(lower(concat_ws('\\n', title, org)), t))"),
    "semantic_search": _RANKED.format(out="id, similarity", order="similarity DESC, id", most=_MOST, rows=f"SELECT id, similarity FROM (SELECT id, {_COSINE} AS similarity FROM fn_embeddings) WHERE similarity >= least"),
    "popular_regions": _RANKED.format(out="region, n", order="n DESC, region", most=_MOST, rows="SELECT region, count(*) AS n FROM fn_notices GROUP BY region"),
    "popular_keywords": _RANKED.format(out="keyword, searches", order="searches DESC, keyword", most=_MOST, rows=f"SELECT trim(props) AS keyword, count(*) AS searches FROM fn_events WHERE ts >= TIMESTAMP_NTZ '{EVENTS_NOW}' - make_dt_interval(days) AND trim(props) <> '' GROUP BY trim(props)"),
    "url_host": "lower(regexp_replace(regexp_extract(trim(url), '(?i)^https?://([^/?#:]+)', 1), '(?i)^www\\\\.', ''))",
    "engagement": "views + 3 * clicks + 5 * favorites",
    "popularity": "views + 2 * clicks + 3 * favorites",
}


def register(spark: SparkSession, notices: DataFrame, synonyms: DataFrame, embeddings: DataFrame, events: DataFrame) -> None:
    """Makes FUNCTIONS known to the session, over notices (id, title, org, end_at, region), synonyms (word, synonym), embeddings (id,
    embedding) and events (ts, props). Called again, the functions read the new tables."""
    for name, frame in (("notices", notices), ("synonyms", synonyms), ("embeddings", embeddings), ("events", events)):
        frame.createOrReplaceTempView(f"fn_{name}")
    for head, kind in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {_BODIES[head.split('(')[0]]}")


def registered(spark: SparkSession, sf_dir: str) -> None:
    register(spark, search._notices(spark, sf_dir), search._synonyms(spark), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), table(spark, sf_dir, "events"))


def fn_search(spark, sf_dir):
    registered(spark, sf_dir)
    return spark.sql("SELECT * FROM notice_search('high', 50)")


def fn_synonym_search(spark, sf_dir):
    registered(spark, sf_dir)
    return spark.sql("SELECT * FROM synonym_search('urgent', 40)")


def fn_semantic_search(spark, sf_dir):
    registered(spark, sf_dir)
    return spark.sql("SELECT id, round(similarity, 5) AS similarity FROM semantic_search((SELECT CAST(embedding AS ARRAY<DOUBLE>) FROM fn_embeddings WHERE id = 0), 0.0D, 10)")


def fn_popular_keywords(spark, sf_dir):
    registered(spark, sf_dir)
    return spark.sql("SELECT * FROM popular_keywords(30, 10)")


def fn_popular_regions(spark, sf_dir):
    registered(spark, sf_dir)
    return spark.sql("SELECT region, n, popularity(n, 1, 2) AS points FROM popular_regions(5)")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("fn_")}
_SIM = "greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])))"
SQL = {
    "fn_search": f"SELECT id, title, end_at FROM {search._N} WHERE (title ILIKE '%high%' OR org ILIKE '%high%') AND end_at >= TIMESTAMP '{ORDERS_NOW}' ORDER BY end_at, id LIMIT 50",
    "fn_synonym_search": f"SELECT id, title, end_at FROM {search._N} WHERE list_bool_or(list_transform(['urgent', 'high', 'asap'], lambda t: contains(lower(title || chr(10) || org), t))) ORDER BY end_at DESC, id LIMIT 40",
    "fn_semantic_search": f"SELECT vec_id AS id, round({_SIM}, 5) AS similarity FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 10",
    "fn_popular_keywords": f"SELECT trim(props) AS keyword, count(*) AS searches FROM events WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAY AND trim(props) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "fn_popular_regions": f"SELECT region, n, CAST(n + 2 + 6 AS DOUBLE) AS points FROM (SELECT region, count(*) AS n FROM {search._N} GROUP BY region) ORDER BY n DESC, region LIMIT 5",
}
