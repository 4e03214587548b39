"""Queries that apply the operators to whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, conversations, decontaminate, hashindex, lexical, licences, packing, quality, simhash, substring, toxicity, vafile, warc
from tilewright.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"), keep_text=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_group_1, p_group_2, toxicity, is_toxic) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashindex.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, licences, n_hits, hits) of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))).drop("text")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after damage."""
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damaged(rows)).withColumnRenamed("conv_id", "_c")
    ids = rows.select("conv_id").distinct().join(found.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents for each item."""
    found = lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_substring_dedup, op3_simhash, op4_toxicity, op5_exact_top_k, op6_nearest, op7_warc, op8_licences, op9_quality, op10_byte_bpe, op11_conversation_repair, op12_lexical_search, op13_decontamination)}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), n AS (
  SELECT doc_id, w, len(w) AS n_words FROM d
), s AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS win FROM n, unnest(range(greatest(n_words - 19, 0))) AS t(i)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM s
), gone AS (
  SELECT DISTINCT doc_id, i + j AS k FROM f, unnest(range(20)) AS t(j) WHERE r > 1
), kept AS (
  SELECT n.doc_id, t.k, w[t.k + 1] AS word FROM n, unnest(range(n_words)) AS t(k)
  ANTI JOIN gone ON gone.doc_id = n.doc_id AND gone.k = t.k
), k AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY k) AS line FROM kept GROUP BY doc_id
)
SELECT n.doc_id, n.n_words, n.n_words - coalesce(k.n_kept, 0) AS n_removed, sha256(coalesce(k.line, '')) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""

OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score, CAST(NULL AS VARCHAR) AS large_score FROM r WHERE rank <= 5
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations
), h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(k, lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 20 AS h FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE h <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
    substr(role, 1, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM d
), f AS (
  SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault, lead(i) OVER (PARTITION BY conv_id ORDER BY n) AS next_i FROM o
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (next_i IS NOT NULL AND i || next_i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY conv_id
), w AS (
  -- Of each state (nothing yet, after s, u, a) the least of cost and audit, the cost in nine digits.
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS e, CAST(NULL AS VARCHAR) AS y, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM s
  UNION ALL
  SELECT conv_id, n, printf('%09d', CAST(left(e, 9) AS INT) + 3) || substr(e, 10) || 'D',
    least(printf('%09d', CAST(left(y, 9) AS INT) + 3) || substr(y, 10) || 'D', CASE WHEN ok AND i = 's' THEN printf('%09d', CAST(left(e, 9) AS INT) + late) || substr(e, 10) || 'K' END),
    least(printf('%09d', CAST(left(u3, 9) AS INT) + 3) || substr(u3, 10) || 'D', CASE WHEN ok AND i = 'u' THEN printf('%09d', CAST(left(f3, 9) AS INT) + late) || substr(f3, 10) || 'K' END, CASE WHEN ok THEN printf('%09d', CAST(left(f3, 9) AS INT) + 2 + late) || substr(f3, 10) || 'R' END),
    least(printf('%09d', CAST(left(a3, 9) AS INT) + 3) || substr(a3, 10) || 'D', CASE WHEN ok AND i = 'a' THEN printf('%09d', CAST(left(u3, 9) AS INT) + late) || substr(u3, 10) || 'K' END, CASE WHEN ok THEN printf('%09d', CAST(left(u3, 9) AS INT) + 2 + late) || substr(u3, 10) || 'R' END)
  FROM (
    -- u3, a3: with insertions; f3: the best from which a user's turn may follow.
    SELECT conv_id, n, e, y, i, ok, late, u3, a3, least(e, y, a3) AS f3 FROM (
      SELECT *, least(u2, printf('%09d', CAST(left(a2, 9) AS INT) + 2) || substr(a2, 10) || 'I') AS u3, a2 AS a3 FROM (
        SELECT *, least(a, printf('%09d', CAST(left(u2, 9) AS INT) + 2) || substr(u2, 10) || 'I') AS a2 FROM (
          SELECT w.*, f.i, fault IN ('.', 't') AS ok, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late, f.n AS m, least(u, printf('%09d', CAST(left(least(e, y, a), 9) AS INT) + 2) || substr(least(e, y, a), 10) || 'I') AS u2
          FROM (SELECT conv_id, n + 1 AS n, e, y, u, a FROM w) w JOIN f ON f.conv_id = w.conv_id AND f.n = w.n))))
), z AS (
  SELECT w.conv_id, least(e, a, printf('%09d', CAST(left(u2, 9) AS INT) + 2) || substr(u2, 10) || 'I') AS best FROM (
    SELECT *, least(u, printf('%09d', CAST(left(least(e, y), 9) AS INT) + 2) || substr(least(e, y), 10) || 'I') AS u2 FROM w) w JOIN s ON s.conv_id = w.conv_id AND s.n = w.n
), l AS (
  SELECT conv_id, k, substr(best, 9 + k, 1) AS edit, count(*) FILTER (substr(best, 9 + k, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS n,
    count(*) FILTER (substr(best, 9 + k, 1) <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place FROM z, unnest(range(1, length(best) - 8)) AS t(k)
), p AS (
  SELECT l.*, f.role, f.text, max(CASE WHEN edit = 'K' AND place = 1 AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led FROM l LEFT JOIN f ON f.conv_id = l.conv_id AND f.n = l.n
), r AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS repaired_sha256 FROM p WHERE edit <> 'D' GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(best, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) b LEFT JOIN s ON s.conv_id = b.conv_id LEFT JOIN z ON z.conv_id = b.conv_id LEFT JOIN r ON r.conv_id = b.conv_id
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t WHERE len(w) > 0
), d AS (
  SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM t, g WHERE len(w) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY r, term
), df AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM tf, g GROUP BY term
), q AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, item_id, term
), s AS (
  SELECT i, item_id, tf.r, d.doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN df ON df.term = q.term JOIN tf ON tf.term = q.term JOIN d ON d.r = tf.r GROUP BY i, item_id, tf.r, d.doc_id
), b AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM b WHERE rank <= 10
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + 10], ' ') AS s FROM i, unnest(range(greatest(len(w) - 10, 0) + 1)) AS t(k) WHERE len(w) > 0
), dw AS (
  SELECT r, k, n, array_to_string(w[k + 1 : k + n], ' ') AS s FROM (SELECT * FROM d, (SELECT DISTINCT n FROM win) AS sizes), unnest(range(greatest(len(w) - n + 1, 0))) AS t(k)
), h AS (
  SELECT dw.r, dw.k, dw.n, win.item_id FROM dw JOIN win ON win.s = dw.s AND win.n = dw.n
), hit AS (
  SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, n FROM h), unnest(range(n)) AS t(j) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN named ON named.r = d.r
"""

ORACLES = {"op11_conversation_repair": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_decontamination": OP13_SQL, "op2_substring_dedup": OP2_SQL, "op5_exact_top_k": OP5_SQL, "op7_warc": OP7_SQL}
