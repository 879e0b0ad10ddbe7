"""Search, facets, joins, sets, windows and orderings.

A notice is an order: its date is the end of application, its priority the title, its customer the
institution, the customer's nation the region, and the brands of its parts are its categories.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeloom.operators import search as S
from noticeloom.operators.ranks import numbered
from noticeloom.sources.tables import ORDERS_NOW, table

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def _now():
    return F.lit(ORDERS_NOW).cast("timestamp_ntz")


def _notices(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("org"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("end_at"),
        F.col("o_totalprice").alias("views"), F.col("c_custkey").alias("institution"), F.col("c_nationkey").alias("region"))


_N = "(SELECT o_orderkey AS id, o_orderpriority AS title, c_mktsegment AS org, o_orderstatus AS status, o_orderdate AS end_at, o_totalprice AS views, c_custkey AS institution, c_nationkey AS region FROM orders JOIN customer ON o_custkey = c_custkey)"


def _categories(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("category")).distinct()


_C = "(SELECT DISTINCT l_orderkey AS id, p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _regions(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    top = spark.range(1).select(F.lit(1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.lit("nation").alias("level"), F.lit("ALL").alias("name"))
    sido = r.select((F.col("r_regionkey") + 100).cast("int").alias("id"), F.lit(1000).alias("parent_id"), F.lit("sido").alias("level"), F.col("r_name").alias("name"))
    sigungu = n.select(F.col("n_nationkey").cast("int").alias("id"), (F.col("n_regionkey") + 100).cast("int").alias("parent_id"), F.lit("sigungu").alias("level"), F.col("n_name").alias("name"))
    return top.unionByName(sido).unionByName(sigungu)


_R = """(SELECT 1000 AS id, NULL AS parent_id, 'nation' AS level, 'ALL' AS name UNION ALL SELECT r_regionkey + 100, 1000, 'sido', r_name FROM region UNION ALL SELECT n_nationkey, n_regionkey + 100, 'sigungu', n_name FROM nation)"""


def _synonyms(spark):
    return spark.createDataFrame([("urgent", "high"), ("asap", "urgent"), ("low", "not specified")], "word string, synonym string")


def f01_keyword(spark, sf_dir):
    return S.keyword(_notices(spark, sf_dir), " uRg ", ["title", "org"]).select("id", "title")


def f02_synonyms(spark, sf_dir):
    return S.synonym_search(_notices(spark, sf_dir), "urgent", _synonyms(spark), ["title", "org"]).select("id", "title")


def f03_open(spark, sf_dir):
    return S.open_at(_notices(spark, sf_dir), "end_at", _now()).select("id", "end_at")


def f05_distinct_from(spark, sf_dir):
    n = table(spark, sf_dir, "orders").withColumn("old", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return n.where(~F.col("old").eqNullSafe(F.col("o_orderstatus"))).select("o_orderkey", "o_orderstatus")


def f07_json_containment(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.get_json_object("props", "$.k") == "69").select("event_id", "props")


def f08_admin_list(spark, sf_dir):
    n = S.keyword(_notices(spark, sf_dir).where((F.col("status") == "O") & F.col("org").isin("BUILDING", "MACHINERY")), "medium", ["title", "org"])
    return n.where(F.col("end_at").isNotNull()).select("id", "title", "org")


def f09_scope_intersection(spark, sf_dir):
    n = S.having(_notices(spark, sf_dir), _categories(spark, sf_dir), "id", "category", ["Brand#11", "Brand#12"])
    return n.where(F.col("region").isin(1, 2, 3)).select("id")


def f11_region_scope(spark, sf_dir):
    r = _regions(spark, sf_dir)
    parts = [S.region_scope(r, i).select(F.lit(i).alias("asked"), "id") for i in (1000, 101, 7)]
    return parts[0].union(parts[1]).union(parts[2])


def f12_region_lineage(spark, sf_dir):
    r = _regions(spark, sf_dir)
    parts = [S.region_lineage(r, i).select(F.lit(i).alias("asked"), "id") for i in (101, 7)]
    return parts[0].union(parts[1])


def f23_my_matches(spark, sf_dir):
    cats = _categories(spark, sf_dir).groupBy("id").agg(F.collect_set("category").alias("cats"))
    n = _notices(spark, sf_dir).join(cats, "id", "left")
    wanted = F.array(F.lit("Brand#13"), F.lit("Brand#21"))
    return n.where(F.col("region").isin(4, 5) | F.coalesce(F.arrays_overlap("cats", wanted), F.lit(False))).select("id")


def z06_public_search(spark, sf_dir):
    n = S.open_at(S.keyword(_notices(spark, sf_dir), "high", ["title", "org"]), "end_at", _now())
    n = S.having(n, _categories(spark, sf_dir), "id", "category", ["Brand#11", "Brand#33"])
    n = n.where(F.col("region").isin(*range(12)))
    return n.orderBy(F.asc_nulls_last("end_at"), "id").limit(S.clamp(None)).select("id", "title", "end_at")


def z07_synonym_search(spark, sf_dir):
    n = S.synonym_search(_notices(spark, sf_dir), "urgent", _synonyms(spark), ["title", "org"])
    return n.dropDuplicates(["id"]).orderBy(F.desc("end_at"), "id").limit(40).select("id", "title", "end_at")


def j01_inner(spark, sf_dir):
    n = _notices(spark, sf_dir)
    r = table(spark, sf_dir, "nation")
    return n.join(r, n.region == r.n_nationkey).groupBy("n_name").agg(F.count("*").alias("notices"))


def j02_left_chain(spark, sf_dir):
    cats = _categories(spark, sf_dir).groupBy("id").agg(F.count("*").alias("categories"), F.min("category").alias("first_category"))
    return _notices(spark, sf_dir).join(cats, "id", "left").select("id", "region", F.coalesce("categories", F.lit(0)).alias("categories"), "first_category")


def j03_semi(spark, sf_dir):
    return S.having(_notices(spark, sf_dir), _categories(spark, sf_dir), "id", "category", ["Brand#45"]).select("id")


def j04_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def j05_exists_value(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_hit", F.lit(True))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left").select("c_custkey", F.when(F.col("_hit").isNotNull(), 45.0).otherwise(0.0).alias("follow_score"))


def j07_range(spark, sf_dir):
    groups = spark.createDataFrame([(1, 0.0, 1000.0), (2, 1000.0, None), (3, None, 0.0)], "group_id int, low double, high double")
    c = table(spark, sf_dir, "customer")
    inside = (F.col("low").isNull() | (F.col("c_acctbal") >= F.col("low"))) & (F.col("high").isNull() | (F.col("c_acctbal") <= F.col("high")))
    return c.join(F.broadcast(groups), inside).groupBy("group_id").agg(F.count("*").alias("people"))


def j08_any_of_three(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.xxhash64(F.struct("*")).alias("id"), "l_orderkey", "l_partkey", "l_suppkey")
    keys = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_suppkey")
    return S.any_key(p, ["l_partkey", "l_suppkey"], keys, "s_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


def j11_lookup_all(spark, sf_dir):
    cats = _categories(spark, sf_dir).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return _notices(spark, sf_dir).join(cats, "id", "left").select("id", "categories")


def j11_lookup(spark, sf_dir):
    return j11_lookup_all(spark, sf_dir)


def j13_institution_counts(spark, sf_dir):
    n = _notices(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("institution"), "s_name")
    own = n.select("institution", "id", "status")
    via = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("institution"), F.col("l_orderkey").alias("id")).distinct().join(n.select("id", "status"), "id").select("institution", "id", "status")
    active = own.union(via).where("status = 'O'").distinct().groupBy("institution").agg(F.count("*").alias("active"))
    counts = own.groupBy("institution").agg(F.count("*").alias("organized"))
    sourced = via.groupBy("institution").agg(F.count("*").alias("sourced"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(counts, "institution", "left").join(sourced, "institution", "left").join(active, "institution", "left").select("institution", "s_name", z("organized"), z("sourced"), z("active"))


def a27_institution_directory(spark, sf_dir):
    return j13_institution_counts(spark, sf_dir).orderBy(F.desc("active"), F.desc("organized"), "s_name").limit(30)


def a01_popular_regions(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").limit(5)


def a11_max_case(spark, sf_dir):
    c = _categories(spark, sf_dir).groupBy("id").agg(F.max(F.when(F.col("category") == "Brand#11", 30).otherwise(0)).alias("category_score"))
    return _notices(spark, sf_dir).join(c, "id", "left").select("id", F.coalesce("category_score", F.lit(0)).alias("category_score"))


def a13_collect(spark, sf_dir):
    return _notices(spark, sf_dir).groupBy("region").agg(F.array_join(F.array_sort(F.collect_set("org")), "|").alias("orgs"), F.count("*").cast("int").alias("n"))


def u01_union(spark, sf_dir):
    return S.synonyms_of(" Urgent", _synonyms(spark))


def u02_union_all_weight(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = e.where("event_type = 'purchase'").select("user_id", F.lit(2).alias("w")).unionAll(e.where("event_type = 'view'").select("user_id", F.lit(1).alias("w")))
    return w.groupBy("user_id").agg(F.sum("w").alias("signals"))


def u04_distinct_after_fanout(spark, sf_dir):
    return _notices(spark, sf_dir).join(_categories(spark, sf_dir), "id").where("category IN ('Brand#11', 'Brand#12', 'Brand#13')").select("id", "title").dropDuplicates(["id"])


def u05_array_sets(spark, sf_dir):
    a = _categories(spark, sf_dir).groupBy("id").agg(F.collect_set("category").alias("c"))
    b = F.array(F.lit("Brand#11"), F.lit("Brand#22"), F.lit("Brand#33"))
    return a.select("id", F.size(F.array_intersect("c", b)).alias("common"), F.size(F.array_union("c", b)).alias("together"), F.size(F.array_except("c", b)).alias("other"))


def u06_merged_feeds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    feed = lambda k: e.where(F.col("event_type") == k).select(F.lit(k).alias("kind"), "event_id", "ts")
    return feed("error").unionByName(feed("signup")).orderBy(F.desc("ts"), "event_id").limit(30)


def w01_keep_first(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "event_id")


def w02_whole_frame(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    total = s.agg(F.count_if(F.col("s_acctbal") > 9000).alias("matches"))
    return s.crossJoin(F.broadcast(total)).select("s_suppkey", "matches", ((F.col("matches") == 1) & (F.col("s_acctbal") > 9000)).alias("unique_match"))


def w03_first_category(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.struct("l_linenumber", "p_brand"))["p_brand"].alias("category"))


def w05_round_robin(spark, sf_dir):
    return numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.pmod(F.col("number") - 1, F.lit(4)).cast("int").alias("batch"))


def w06_best_of(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.struct("p_size", "p_retailprice", "p_partkey")).alias("b")).select("p_brand", F.col("b.p_partkey").alias("p_partkey"), F.col("b.p_size").alias("area"))


def _ordered(order, k=60, where=None):
    def query(spark, sf_dir):
        n = _notices(spark, sf_dir)
        return (n.where(where) if where else n).orderBy(*order()).limit(k).select("id", "end_at", "views")
    return query


def t05_admin_sort(spark, sf_dir):
    n = _notices(spark, sf_dir)
    return n.orderBy(F.when(F.col("status") == "O", 0).when(F.col("status") == "P", 1).otherwise(2), F.asc_nulls_last("end_at"), "id").limit(70).select("id", "status", "end_at")


def t06_deadline_rank(spark, sf_dir):
    n = _notices(spark, sf_dir)
    rank = F.when(F.col("end_at").isNull(), 2).when(F.col("end_at") < _now(), 1).otherwise(0)
    return n.select("id", "end_at", rank.alias("rank")).orderBy("rank", "end_at", "id").limit(60)


def t07_page(spark, sf_dir):
    return S.page(_notices(spark, sf_dir).select("id", "views"), [F.desc("views"), "id"], 40, 20)


def s04_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("closed"), F.count_if(F.col("o_orderdate") >= _now()).alias("ahead"))


def s01_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") <= 250000))
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


def s03_key_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


def a26_home_summary(spark, sf_dir):
    n, now = _notices(spark, sf_dir), _now()
    d = F.col("end_at")
    return n.agg(F.count_if(F.to_date(d) == F.to_date(now)).alias("today"), F.count_if((F.col("status") == "O") & (d >= now)).alias("active"), F.count_if((d >= now) & (d <= now + F.expr("INTERVAL 7 DAYS"))).alias("due_7_days"), F.count_distinct(F.when(d >= now, F.col("institution"))).alias("sources"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "acdfjlstuvwxz" and k[1:3].isdigit() and callable(v)} | {
    "t01_sort_deadline": _ordered(lambda: [F.asc_nulls_last("end_at"), "id"]), "t03_score_then_created": _ordered(lambda: [F.desc("views"), F.desc("end_at"), "id"], k=30),
    "t10_urgent_feed": _ordered(lambda: [F.asc_nulls_last("end_at"), "id"], k=8, where=f"status = 'O' AND end_at >= {_NOW.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}"), "t10_popular_feed": _ordered(lambda: [F.desc("views"), "id"], k=8),
}
_CLOSED = f"(end_at IS NULL OR end_at >= {_NOW})"
_SYN = "(contains(lower(title || chr(10) || org), 'urgent') OR contains(lower(title || chr(10) || org), 'high') OR contains(lower(title || chr(10) || org), 'asap'))"
_COUNTS = f"""(SELECT s_suppkey AS institution, s_name, coalesce(organized, 0) AS organized, coalesce(sourced, 0) AS sourced, coalesce(active, 0) AS active FROM supplier
  LEFT JOIN (SELECT institution, count(*) AS organized FROM {_N} GROUP BY 1) a ON a.institution = s_suppkey
  LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS sourced FROM lineitem GROUP BY 1) b ON b.l_suppkey = s_suppkey
  LEFT JOIN (SELECT i, count(*) AS active FROM (SELECT institution AS i, id FROM {_N} WHERE status = 'O' UNION SELECT l_suppkey, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O') GROUP BY 1) c ON c.i = s_suppkey)"""
SQL = {
    "f01_keyword": f"SELECT id, title FROM {_N} WHERE title ILIKE '%uRg%' OR org ILIKE '%uRg%'",
    "f02_synonyms": f"SELECT id, title FROM {_N} WHERE {_SYN}",
    "f03_open": f"SELECT id, end_at FROM {_N} WHERE {_CLOSED}",
    "f05_distinct_from": "SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END IS DISTINCT FROM o_orderstatus",
    "f07_json_containment": "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '69'",
    "f08_admin_list": f"SELECT id, title, org FROM {_N} WHERE status = 'O' AND org IN ('BUILDING', 'MACHINERY') AND (title ILIKE '%medium%' OR org ILIKE '%medium%') AND end_at IS NOT NULL",
    "f09_scope_intersection": f"SELECT id FROM {_N} WHERE region IN (1, 2, 3) AND id IN (SELECT id FROM {_C} WHERE category IN ('Brand#11', 'Brand#12'))",
    "f11_region_scope": f"SELECT 1000 AS asked, id FROM {_R} UNION ALL SELECT 101, id FROM {_R} WHERE id = 101 OR parent_id = 101 UNION ALL SELECT 7, id FROM {_R} WHERE id = 7 OR id = (SELECT parent_id FROM {_R} WHERE id = 7)",
    "f12_region_lineage": f"SELECT 101 AS asked, id FROM {_R} WHERE id IN (101, 1000) OR parent_id = 101 UNION ALL SELECT 7, id FROM {_R} WHERE id IN (7, 1000) OR id = (SELECT parent_id FROM {_R} WHERE id = 7)",
    "f23_my_matches": f"SELECT id FROM {_N} WHERE region IN (4, 5) OR id IN (SELECT id FROM {_C} WHERE category IN ('Brand#13', 'Brand#21'))",
    "z06_public_search": f"SELECT id, title, end_at FROM {_N} WHERE (title ILIKE '%high%' OR org ILIKE '%high%') AND {_CLOSED} AND region < 12 AND id IN (SELECT id FROM {_C} WHERE category IN ('Brand#11', 'Brand#33')) ORDER BY end_at NULLS LAST, id LIMIT 60",
    "z07_synonym_search": f"SELECT id, title, end_at FROM {_N} WHERE {_SYN} ORDER BY end_at DESC, id LIMIT 40",
    "j01_inner": f"SELECT n_name, count(*) AS notices FROM {_N} JOIN nation ON region = n_nationkey GROUP BY 1",
    "j02_left_chain": f"SELECT n.id, region, count(category) AS categories, min(category) AS first_category FROM {_N} n LEFT JOIN {_C} c ON n.id = c.id GROUP BY 1, 2",
    "j03_semi": f"SELECT id FROM {_N} n WHERE EXISTS (SELECT 1 FROM {_C} c WHERE c.id = n.id AND category = 'Brand#45')",
    "j04_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "j05_exists_value": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 45.0::DOUBLE ELSE 0.0::DOUBLE END AS follow_score FROM customer",
    "j07_range": "SELECT group_id, count(*) AS people FROM customer JOIN (VALUES (1, 0.0, 1000.0), (2, 1000.0, NULL), (3, NULL, 0.0)) g(group_id, low, high) ON (low IS NULL OR c_acctbal >= low) AND (high IS NULL OR c_acctbal <= high) GROUP BY 1",
    "j08_any_of_three": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1",
    "j11_lookup": f"SELECT n.id, string_agg(category, ',' ORDER BY category) AS categories FROM {_N} n LEFT JOIN {_C} c ON c.id = n.id GROUP BY 1",
    "j11_lookup_all": f"SELECT n.id, string_agg(category, ',' ORDER BY category) AS categories FROM {_N} n LEFT JOIN {_C} c ON c.id = n.id GROUP BY 1",
    "j13_institution_counts": f"SELECT * FROM {_COUNTS}",
    "a27_institution_directory": f"SELECT * FROM {_COUNTS} ORDER BY active DESC, organized DESC, s_name LIMIT 30",
    "a01_popular_regions": "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "a11_max_case": f"SELECT n.id, CAST(coalesce(max(CASE WHEN category = 'Brand#11' THEN 30 ELSE 0 END), 0) AS INT) AS category_score FROM {_N} n LEFT JOIN {_C} c ON c.id = n.id GROUP BY 1",
    "a13_collect": f"SELECT region, string_agg(DISTINCT org, '|' ORDER BY org) AS orgs, CAST(count(*) AS INT) AS n FROM {_N} GROUP BY 1",
    "u01_union": "SELECT 'urgent' AS term UNION SELECT 'high' UNION SELECT 'asap'",
    "u02_union_all_weight": "SELECT user_id, CAST(sum(w) AS BIGINT) AS signals FROM (SELECT user_id, 2 AS w FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 1 FROM events WHERE event_type = 'view') GROUP BY 1",
    "u04_distinct_after_fanout": f"SELECT DISTINCT n.id, title FROM {_N} n JOIN {_C} c ON n.id = c.id WHERE category IN ('Brand#11', 'Brand#12', 'Brand#13')",
    "u05_array_sets": f"SELECT id, CAST(count(*) FILTER (category IN ('Brand#11', 'Brand#22', 'Brand#33')) AS INT) AS common, CAST(3 + count(*) FILTER (category NOT IN ('Brand#11', 'Brand#22', 'Brand#33')) AS INT) AS together, CAST(count(*) FILTER (category NOT IN ('Brand#11', 'Brand#22', 'Brand#33')) AS INT) AS other FROM {_C} GROUP BY 1",
    "u06_merged_feeds": "SELECT event_type AS kind, event_id, ts FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 30",
    "w01_keep_first": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "w02_whole_frame": "SELECT s_suppkey, count(*) FILTER (s_acctbal > 9000) OVER () AS matches, count(*) FILTER (s_acctbal > 9000) OVER () = 1 AND s_acctbal > 9000 AS unique_match FROM supplier",
    "w03_first_category": "SELECT l_orderkey AS id, arg_min(p_brand, (l_linenumber, p_brand)) AS category FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "w05_round_robin": "SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 4 AS INT) AS batch FROM supplier",
    "w06_best_of": "SELECT p_brand, p_partkey, p_size AS area FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) = 1",
    "t01_sort_deadline": f"SELECT id, end_at, views FROM {_N} ORDER BY end_at NULLS LAST, id LIMIT 60",
    "t03_score_then_created": f"SELECT id, end_at, views FROM {_N} ORDER BY views DESC, end_at DESC, id LIMIT 30",
    "t05_admin_sort": f"SELECT id, status, end_at FROM {_N} ORDER BY CASE status WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, end_at NULLS LAST, id LIMIT 70",
    "t06_deadline_rank": f"SELECT id, end_at, CAST(CASE WHEN end_at IS NULL THEN 2 WHEN end_at < {_NOW} THEN 1 ELSE 0 END AS INT) AS rank FROM {_N} ORDER BY 3, 2, 1 LIMIT 60",
    "t07_page": f"SELECT id, views, (SELECT count(*) FROM {_N}) AS total FROM {_N} ORDER BY views DESC, id LIMIT 20 OFFSET 40",
    "t10_urgent_feed": f"SELECT id, end_at, views FROM {_N} WHERE status = 'O' AND end_at >= {_NOW} ORDER BY end_at, id LIMIT 8",
    "t10_popular_feed": f"SELECT id, end_at, views FROM {_N} ORDER BY views DESC, id LIMIT 8",
    "s01_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 100000 AND 250000 ORDER BY 2 DESC, 1 LIMIT 100",
    "s03_key_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
    "s04_counts": f"SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderdate >= {_NOW}) AS ahead FROM orders",
    "a26_home_summary": f"SELECT count(*) FILTER (CAST(end_at AS DATE) = CAST({_NOW} AS DATE)) AS today, count(*) FILTER (status = 'O' AND end_at >= {_NOW}) AS active, count(*) FILTER (end_at >= {_NOW} AND end_at <= {_NOW} + INTERVAL 7 DAY) AS due_7_days, count(DISTINCT CASE WHEN end_at >= {_NOW} THEN institution END) AS sources FROM {_N}",
}
