"""The operators' queries, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_byte_bpe
from .classifier import op4_quality_classifier
from .edit_counts import op1_token_counts
from .knn import op5_exact_topk
from .minhash import op7_minhash_neardup
from .packing import op3_best_fit_packing
from .rules import op8_quality_rules
from .suffixes import op10_suffix_dedup
from .toxicity import op6_toxicity
from .warc import op2_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_topk": op5_exact_topk,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
            FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_minhash_neardup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS shingle FROM d WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op8_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents
        ), tri AS (
            SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
        ), twice AS (
            SELECT doc_id, i FROM tri JOIN (SELECT doc_id, g FROM tri GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)
        ), cover AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1
        ), m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, (length(t) - length(replace(t, '!!', ''))) // 2 AS shout
            FROM d LEFT JOIN cover USING (doc_id)
        ), f AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END
                + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END
                + CASE WHEN 100 * upper > 60 * letters THEN 32 ELSE 0 END + CASE WHEN 100 * shout > 30 * n_words THEN 64 ELSE 0 END)::INT AS failed FROM m
        ), alone AS (
            SELECT failed, ['few_words', 'repeated_spans', 'symbol_heavy', 'repeated_lines', 'odd_word_length', 'mostly_capitals', 'shouting'][log2(failed)::INT + 1] AS only_rule, count(*) AS n_rejected_alone FROM f WHERE failed IN (1, 2, 4, 8, 16, 32, 64) GROUP BY 1
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, 2 AS policy, only_rule, n_rejected_alone FROM f LEFT JOIN alone USING (failed)
    """,
    "op10_suffix_dedup": r"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), part AS (
            SELECT doc_id, k, substr(x, 400 * k + 1, 498) AS p FROM (SELECT doc_id, x, unnest(range(0, (n - 50) // 200 + 1)) AS k FROM d WHERE n >= 50)
        ), s AS (
            SELECT doc_id, 200 * k + j AS i, substr(p, 2 * j + 1, 100) AS g FROM (SELECT doc_id, k, p, unnest(range(0, length(p) // 2 - 49)) AS j FROM part)
        ), hit AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)) USING (g) WHERE doc_id > first
        ), run AS (
            SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit
        ), span AS (
            SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r
        ), gap AS (
            SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span
        ), kept AS (
            SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS x, sum(z - a) AS n_removed, count(*) AS n_spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
}
