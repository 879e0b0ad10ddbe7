"""Vectors and recommendation: orders as notices, embeddings by number, part sizes as audiences."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeloom.functions import vectors as V
from noticeloom.operators import recommend as R
from noticeloom.operators import vector_index as N
from noticeloom.operators import search as S
from noticeloom.sources.tables import ORDERS_NOW, table

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"
_ME = R.Person(region=7, age=R.BAND_AGES["30s"], gender=None, categories=("Brand#11", "Brand#33"), follows=tuple(range(5, 100, 10)))


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _dealt(spark, sf_dir, rows, id_):
    """rows with vec_id: their ids dealt out to all vectors in turn."""
    number = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("_vectors"))
    return rows.crossJoin(F.broadcast(number)).withColumn("vec_id", F.pmod(id_, F.col("_vectors"))).drop("_vectors")


def _notices(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = o.select(F.col("o_orderkey").alias("id"), F.array("o_custkey").alias("institutions"), F.col("o_orderdate").alias("end_at"), "o_custkey")
    return _dealt(spark, sf_dir, n, F.col("id")).join(e, "vec_id", "left")


def _recommended(spark, sf_dir, weights, likes=False):
    n = _notices(spark, sf_dir)
    c, l, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    regions = n.join(c, F.col("o_custkey") == F.col("c_custkey")).select("id", F.col("c_nationkey").alias("region"), (F.col("c_nationkey") == 0).alias("nationwide"))
    parts = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_size").alias("min_age"), (F.col("p_size") + 5).alias("max_age"), F.lit(None).cast("string").alias("gender"))
    now = F.lit(ORDERS_NOW).cast("timestamp_ntz")
    q = None
    if likes:
        n = n.crossJoin(F.broadcast(_query_vector(spark, sf_dir)))
        q = F.col("q")
    out = R.recommend(n, regions, parts.select("id", "category"), parts.where("min_age > 30").select("id", "min_age", "max_age", "gender"), _ME, now, weights, q)
    rounded = lambda c: F.round(c, 5).alias(c)
    return out.orderBy(F.desc(F.round("score", 5)), F.desc("end_at"), "id").limit(100).select("id", "end_at", rounded("score"), rounded("similarity"))


def z01_recommend_first(spark, sf_dir):
    return _recommended(spark, sf_dir, R.FIRST)


def z02_recommend(spark, sf_dir):
    return _recommended(spark, sf_dir, R.Weights(), True)


def z03_recommend_audience(spark, sf_dir):
    return _recommended(spark, sf_dir, R.AUDIENCE)


def _signals(spark, sf_dir):
    e = _dealt(spark, sf_dir, table(spark, sf_dir, "events"), F.col("event_id")).select("user_id", "ts", "event_type", F.col("vec_id").alias("item"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    return e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), v


def z04_interest_vector(spark, sf_dir):
    mean = R.interest_vector(*_signals(spark, sf_dir))
    return mean.select("user_id", F.posexplode("mean").alias("i", "x")).select("user_id", "i", F.round("x", 5).alias("x"))


def z05_semantic_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id <> 0 AND label IN (0, 1, 2, 3)").crossJoin(F.broadcast(_query_vector(spark, sf_dir)))
    return S.nearest(rows, "embedding", F.col("q"), 0.2, 20, ["vec_id"]).select("vec_id", F.round("similarity", 5).alias("similarity"))


def t04_vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(_query_vector(spark, sf_dir)))
    return S.nearest(rows, "embedding", F.col("q"), 0.0, 10, ["vec_id"]).select("vec_id", F.round("similarity", 5).alias("similarity"))


def t04_vector_index(spark, sf_dir):
    """The ten nearest of each vector whose id is divisible by 100, over the index of all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = N.build(rows, 64)
    queries = index.rows.where("id % 100 = 0").select(F.col("id").alias("query"), "unit")
    return N.search(queries, index, 10).select("query", "id", "rank", F.round("similarity", 5).alias("similarity"))


def v01_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(_query_vector(spark, sf_dir)))
    return rows.select("vec_id", F.round(1 - V.cosine(F.col("embedding"), F.col("q")), 5).alias("distance"))


def v02_mean_vector(spark, sf_dir):
    mean = V.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return mean.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


def v04_vector_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.is_valid(F.col("embedding"), 64).alias("valid"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "tvz" and k[1:3].isdigit()}
_LIVE = f"(SELECT o_orderkey AS id, o_custkey, o_orderdate AS end_at, embedding FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings) WHERE o_orderstatus <> 'F' AND o_orderdate > {_NOW})"


def _sql(w: R.Weights, likes: bool) -> str:
    alike = "greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])))" if likes else "CAST(NULL AS DOUBLE)"
    score = f"""CASE WHEN o_custkey IN {_ME.follows} THEN {w.follow} ELSE 0 END + CASE WHEN c_nationkey = {_ME.region} THEN {w.region} WHEN c_nationkey = 0 THEN {w.nationwide} ELSE 0 END
      + coalesce(cat, 0) + coalesce(aud, 0) + CASE WHEN end_at - {_NOW} < INTERVAL 7 DAY THEN {w.urgent} ELSE 0 END + coalesce(sim, 0) * {w.likeness}"""
    return f"""SELECT id, end_at, round(CAST({score} AS DOUBLE), 5) AS score, round(sim, 5) AS similarity FROM (SELECT *, {alike} AS sim FROM {_LIVE}) n JOIN customer ON o_custkey = c_custkey
      LEFT JOIN (SELECT l_orderkey, max(CASE WHEN p_brand IN ('Brand#11', 'Brand#33') THEN {w.category} ELSE 0 END) AS cat FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) c ON c.l_orderkey = id
      LEFT JOIN (SELECT l_orderkey, max(CASE WHEN {_ME.age} BETWEEN p_size AND p_size + 5 THEN {w.audience} ELSE {w.other_audience} END) AS aud FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 30 GROUP BY 1) a ON a.l_orderkey = id
      ORDER BY 3 DESC, 2 DESC, 1 LIMIT 100"""


_DIST = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"
SQL = {
    "z01_recommend_first": _sql(R.FIRST, False), "z02_recommend": _sql(R.Weights(), True), "z03_recommend_audience": _sql(R.AUDIENCE, False),
    "z04_interest_vector": """WITH s AS (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS item, 2.0 AS w FROM events WHERE event_type = 'purchase' UNION ALL
        SELECT user_id, item, 1.0 FROM (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS item, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) <= 50)
        SELECT user_id, CAST(i - 1 AS INT) AS i, round(sum(w * CAST(embedding[i] AS DOUBLE)) / sum(w), 5) AS x FROM s JOIN embeddings ON vec_id = item, generate_series(1, 64) g(i) GROUP BY 1, 2""",
    "z05_semantic_search": f"SELECT vec_id, round(greatest(0.0, {_DIST}), 5) AS similarity FROM embeddings WHERE vec_id <> 0 AND label IN (0, 1, 2, 3) AND {_DIST} >= 0.2 ORDER BY {_DIST} DESC, vec_id LIMIT 20",
    "t04_vector_topk": f"SELECT vec_id, round(greatest(0.0, {_DIST}), 5) AS similarity FROM embeddings ORDER BY greatest(0.0, {_DIST}) DESC, vec_id LIMIT 10",
    "v01_cosine": f"SELECT vec_id, round(1 - {_DIST}, 5) AS distance FROM embeddings",
    "v02_mean_vector": "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2",
    "v04_vector_check": "SELECT vec_id, len(embedding) = 64 AS valid FROM embeddings",
}
