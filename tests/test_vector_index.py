"""The vector index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeloom.operators import vector_index as N
from noticeloom.plans import recommend


def _pairs(df):
    return {(r["query"], r["id"]) for r in df.collect()}


def test_recall_of_the_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    units = N.units(rows, 64)
    want = _pairs(N.exact(units.where("id % 100 = 0").select(F.col("id").alias("query"), "unit"), units, 10))
    got = _pairs(recommend.t04_vector_index(spark, data))
    assert len(want) == 50 and len(got & want) >= 0.9 * len(want)


def test_every_vector_lies_in_a_cell_and_clusters_are_found(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8)) * 4
    points = [(i, [float(x) for x in centres[i % 12] + r.normal(size=8) * 0.3]) for i in range(1200)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7), (5003, [float("nan")] * 8), (0, points[0][1])]
    rows = spark.createDataFrame(points + odd, "id long, vector array<double>")
    index = N.build(rows, 8, recall=0.9, cells=24)
    assert index.rows.count() == 1201 and index.rows.where("cell IS NULL").isEmpty() and index.cells.count() == 24 and index.probes <= 8
    queries = index.rows.where("id % 100 = 7").select(F.col("id").alias("query"), "unit")
    truth, got = _pairs(N.exact(queries, index.rows, 10)), _pairs(N.search(queries, index, 10))
    assert len(truth) == 120 and len(truth & got) >= 0.9 * 120
    every = N.search(queries, N.Index(index.cells, index.rows, 24), 10)  # all cells: the exact scan
    assert _pairs(every) == truth
    near = N.search(queries, index, 10, least=0.9999)
    assert near.where("similarity < 0.9999").isEmpty()


def test_nearest_cells_by_products_of_matrices(spark):
    r = np.random.default_rng(5)
    points, centres = r.normal(size=(500, 6)), r.normal(size=(40, 6))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, unit array<double>").coalesce(1)
    cells = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    found = N._with_cells(rows, cells, 3)
    want = np.argsort(((points[:, None] - centres) ** 2).sum(axis=2), axis=1)[:, :3]
    assert {r["id"]: r["cells"] for r in found.collect()} == dict(enumerate(want.tolist()))
    assert N._with_cells(rows, cells.limit(0), 3).where("size(cells) > 0").isEmpty() and len(N._with_cells(rows, cells, 99).first()["cells"]) == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "Join" not in plan  # no row's distances in columns


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.0, 1.0])]])
def test_few_vectors(spark, rows):
    index = N.build(spark.createDataFrame(rows, "id long, vector array<double>"), 2)
    found = N.search(index.rows.select(F.col("id").alias("query"), "unit"), index, 3, least=-1.0)
    assert _pairs(found) == {(a, b) for a, _ in rows for b, _ in rows if a != b} or index.probes < len(rows)


def test_session_functions_equal_the_operators(spark, data):
    from noticeloom.functions.urls import host
    from noticeloom.operators import search as S
    from noticeloom.plans import search, session_functions

    session_functions.registered(spark, data)
    rows = lambda df: [tuple(r) for r in df.collect()]
    for term in ("high", " MEDIUM ", "%", "", "none such"):
        want = S.open_at(S.keyword(search._notices(spark, data), term, ["title", "org"]), "end_at", search._now()).orderBy(F.asc_nulls_last("end_at"), "id").limit(7).select("id", "title", "end_at")
        assert rows(spark.sql("SELECT * FROM notice_search(:t, 7)", {"t": term})) == rows(want)
    assert spark.sql("SELECT * FROM synonym_search('order', NULL)").count() <= S.clamp(None) and spark.sql("SELECT * FROM notice_search(NULL, -3)").count() == 1
    assert "TakeOrderedAndProject" in spark.sql("SELECT * FROM notice_search('high', 5)")._jdf.queryExecution().executedPlan().toString()  # no sort of all rows in one task
    urls = spark.read.parquet(f"{data}/pages.parquet").select("url", host(F.col("url")).alias("want"))
    urls.createOrReplaceTempView("fn_urls")
    assert spark.sql("SELECT * FROM fn_urls WHERE coalesce(want, '') <> url_host(url)").isEmpty()
    assert spark.sql("SELECT engagement(1, 2, 3)").first()[0] == 22


def test_no_pair_of_vectors_is_a_row_but_the_nearest(spark, monkeypatch):
    """Across tiles and strips, the similarities and ranks of single pairs, ties by id; vectors aren't joined with queries."""
    monkeypatch.setattr(N, "TILE", 64)
    monkeypatch.setattr(N, "STRIP", 5)
    r = np.random.default_rng(8)
    points = r.normal(size=(400, 6))
    points[350:] = points[:50]  # copies
    units = points / np.sqrt((points**2).sum(axis=1))[:, None]
    rows = spark.createDataFrame([(i, u.tolist(), i % 3) for i, u in enumerate(units)], "id long, unit array<double>, cell int")
    cells = spark.createDataFrame([(k, [float(k)] * 6) for k in range(3)], "cell int, centre array<double>")
    queries = rows.where("id % 9 = 0").select(F.col("id").alias("query"), "unit")
    found = N.search(queries, N.Index(cells, rows, 3), 7, least=0.2)
    want = []
    for q in range(0, 400, 9):
        shares = {i: float(np.cumsum(units[q] * units[i])[-1]) for i in range(400) if i != q}
        order = sorted((i for i in shares if shares[i] >= 0.2), key=lambda i: (-shares[i], i))[:7]
        want += [(q, i, shares[i], k + 1) for k, i in enumerate(order)]
    assert sorted(map(tuple, found.select("query", "id", "similarity", "rank").collect())) == sorted(want)
    assert "FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    some = N.search(queries, N.Index(cells, rows, 1), 7)
    assert some.count() == 7 * queries.count() and some.join(rows, "id").groupBy("query").agg(F.count_distinct("cell").alias("n")).where("n > 1").isEmpty()
