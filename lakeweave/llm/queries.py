"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op4_decontaminate
from .knn_join import op1_knn_join
from .language import op10_language
from .lattice import op2_lattice
from .licenses import op7_licenses
from .line_dedup import op5_line_dedup
from .mixing import op3_mixing
from .ngram_join import op8_ngram_join
from .secrets import op6_secrets
from .sharding import op9_sharding

QUERIES = {
    "op1_knn_join": op1_knn_join,
    "op2_lattice": op2_lattice,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_ngram_join": op8_ngram_join,
    "op9_sharding": op9_sharding,
    "op10_language": op10_language,
}

ORACLE: dict[str, str] = {
    "op1_knn_join": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), q AS (
            SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # Links by counted common shingles, then the smallest doc_id that is reached from each document.
    "op8_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w
        ), classes AS MATERIALIZED (
            SELECT min(doc_id) AS doc_id, list(doc_id) AS members, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
        ), g AS MATERIALIZED (
            SELECT doc_id, n, unnest(s) AS g FROM classes
        ), links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), smallest AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        ), named AS (
            SELECT unnest(c.members) AS doc_id, s.component_id FROM classes c JOIN smallest s ON c.doc_id = s.a
        )
        SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(x.component_id, t.doc_id) AS component_id FROM sets t LEFT JOIN named x ON t.doc_id = x.doc_id
    """,
}
