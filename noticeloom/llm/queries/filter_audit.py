from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..filter_audit import audit, failure_flags, with_labels


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = with_labels(failure_flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return audit(flagged).drop("filter")


QUERIES = {"op11_filter_audit": op11_filter_audit}
SQL = {
    "op11_filter_audit": r"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        failed AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                     || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS f FROM texts),
        cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, f),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, k, substr(o, k, 1) AS x, left(o, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
        found AS (SELECT o, k, x, part, n, good, toxic, contains(f, x) AS fails, f = x AS sole, len(list_intersect(string_split(before, ''), string_split(f, ''))) = 0 OR before = '' OR f = '' AS reaches
                  FROM steps, cells),
        counted AS (SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, x, coalesce(sum(n) FILTER (reaches AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (reaches AND fails), 0) AS removed,
                      coalesce(sum(n) FILTER (fails AND NOT reaches), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
                      coalesce(sum(good) FILTER (reaches AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (reaches AND fails), 0) AS toxic_lost FROM found GROUP BY part, o, k, x)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
    """,
}
