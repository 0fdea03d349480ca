"""Text, record, matrix and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import matrix, text
from chronogrid.sources.views import base, view, with_views


def _m(s, d):
    return view(s, d, "coo_matrix")


RELEVANCE = "COALESCE(CASE WHEN contains(lower({0}), 'an') THEN 2.0 / length({0}) ELSE 0 END, 0)"
QUERIES = {
    "chunk_chars": lambda s, d: text.chunk_chars(base(s, d, "documents")),
    "search_relevance": lambda s, d: text.search_relevance(base(s, d, "part"), ["p_name", "p_type"], "an", "p_partkey").withColumn("score", F.round("score", 6)),
    "matrix_add": lambda s, d: matrix.matrix_add(_m(s, d), matrix.matrix_transpose(_m(s, d))),
    "matrix_subtract": lambda s, d: matrix.matrix_add(_m(s, d), matrix.matrix_transpose(_m(s, d)), -1),
    "matrix_transpose": lambda s, d: matrix.matrix_transpose(_m(s, d)),
    "matrix_multiply": lambda s, d: matrix.matrix_multiply(_m(s, d), _m(s, d)),
}

ORACLES = {
    "chunk_chars": "SELECT doc_id, CAST(k AS INT) AS chunk, CASE WHEN k = 0 THEN substr(text, 1, 201) ELSE substr(text, CAST(k * 200 + 2 AS BIGINT), 200) END AS body FROM (SELECT doc_id, text, unnest(range(CAST(floor((length(text) - 2) / 200.0) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 1)",
    "search_relevance": f"SELECT p_partkey, p_name, p_type, round({RELEVANCE.format('p_name')} + {RELEVANCE.format('p_type')}, 6) AS score FROM part WHERE {RELEVANCE.format('p_name')} + {RELEVANCE.format('p_type')} > 0",
    "matrix_add": with_views("SELECT i, j, SUM(v) AS v FROM (SELECT i, j, v FROM coo_matrix UNION ALL SELECT j, i, v FROM coo_matrix) GROUP BY i, j", "coo_matrix"),
    "matrix_subtract": with_views("SELECT i, j, SUM(v) AS v FROM (SELECT i, j, v FROM coo_matrix UNION ALL SELECT j, i, -v FROM coo_matrix) GROUP BY i, j", "coo_matrix"),
    "matrix_transpose": with_views("SELECT j AS i, i AS j, v FROM coo_matrix", "coo_matrix"),
    "matrix_multiply": with_views("SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM coo_matrix a JOIN coo_matrix b ON a.j = b.i GROUP BY a.i, b.j", "coo_matrix"),
}
