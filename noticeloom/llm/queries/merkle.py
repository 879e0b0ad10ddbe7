from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..merkle import verify


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"))


_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"
# crc32 bit by bit; 3988292384 is its reflected polynomial
_STEP = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {_STEP}), 4294967295)"

QUERIES = {"op13_merkle": op13_merkle}
SQL = {
    "op13_merkle": f"""
        WITH RECURSIVE made AS (
            SELECT doc_id, source, {_LEAF.format(text='text')} AS h, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text='text')} END AS copy FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM made),
        up AS (SELECT source, 0 AS k, i, n, h FROM leaves
               UNION ALL SELECT source, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY source, k, i // 3, n),
        subroots AS (SELECT source, k AS height, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (SELECT 0 AS k, i, n, subroot AS h FROM subroots
                UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 3, n),
        root AS (SELECT h AS root, k AS height FROM top WHERE n = 1),
        fold AS (SELECT l.doc_id, l.source, l.i AS leaf_i, l.h AS leaf, s.height, s.i AS top_i, 0 AS k, l.i, l.copy AS h, '' AS proof FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
                 UNION ALL
                 SELECT f.doc_id, f.source, leaf_i, leaf, f.height, top_i, f.k + 1, CASE WHEN f.k + 1 = f.height THEN top_i ELSE f.i // 3 END,
                        sha256(string_agg(CASE WHEN x.i = f.i THEN f.h ELSE x.h END, '' ORDER BY x.i)), f.proof || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> f.i), '')
                 FROM fold f JOIN (SELECT source, k, i, h FROM up) x ON f.k < f.height AND x.source IS NOT DISTINCT FROM f.source AND x.k = f.k AND x.i // 3 = f.i // 3
                 GROUP BY f.doc_id, f.source, leaf_i, leaf, f.height, top_i, f.k, f.i, f.h, f.proof),
        start AS (SELECT doc_id, source, leaf_i, leaf, 0 AS k, top_i AS i, h, proof FROM fold WHERE k = height),
        last AS (SELECT * FROM start
                 UNION ALL
                 SELECT f.doc_id, f.source, leaf_i, leaf, f.k + 1, f.i // 3, sha256(string_agg(CASE WHEN x.i = f.i THEN f.h ELSE x.h END, '' ORDER BY x.i)),
                        f.proof || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> f.i), '')
                 FROM last f JOIN top x ON f.k < (SELECT height FROM root) AND x.k = f.k AND x.i // 3 = f.i // 3
                 GROUP BY f.doc_id, f.source, leaf_i, leaf, f.k, f.i, f.h, f.proof)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM last JOIN root ON last.k = root.height JOIN subroots s ON s.source IS NOT DISTINCT FROM last.source
    """,
}
