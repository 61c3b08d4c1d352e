"""Registered queries of the pipeline operators, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshift.catalog.base import Query, table
from featshift.llm import cap_filters, centroids, decontaminate, hard_negatives, line_dedup, minhash, nearest, pieces, ppm, quality, suffix_dedup, token_counts, warc
from featshift.storage import fresh_path


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine; the executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~quality.held_out("doc_id", 0, 10)).alias("trained"))
    scored = ppm.score_texts(docs, "trained")
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_OP3 = r"""WITH l AS (
  SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, no, line, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
s AS (SELECT ws, len(ws) AS n, min(doc_id * 1000000 + no) AS first_at FROM w WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT first_at, n, unnest(ws) AS t FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY first_at ORDER BY df, t) AS k FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM t)),
x AS (SELECT * FROM f WHERE k <= n - ceil(n * 0.8) + 1),
c AS (SELECT DISTINCT b.first_at AS y, a.first_at AS x FROM x a JOIN x b ON a.t = b.t AND a.first_at < b.first_at AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
m AS (SELECT DISTINCT y FROM (SELECT y, x, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
      FROM c JOIN t a ON a.first_at = y JOIN t b ON b.first_at = x AND a.t = b.t GROUP BY y, x) WHERE n_both * 100 >= (na + nb - n_both) * 80),
g AS (SELECT w.*, first_at IS NOT NULL AND (doc_id * 1000000 + no <> first_at OR m.y IS NOT NULL) AS gone
      FROM w LEFT JOIN s ON s.ws = w.ws LEFT JOIN m ON m.y = s.first_at)
SELECT d.doc_id, CAST(count(line) AS BIGINT) AS n_lines, CAST(count(line) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.cosine_groups(table(spark, sf_dir, "embeddings"), cosine=0.93)


SQL_OP4 = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) >= 0.93 * a.norm * b.norm),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT e.w, r.c FROM r JOIN e ON e.u = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT m.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(m.c AS BIGINT) AS component_id, m.vec_id = m.c AS kept
FROM m LEFT JOIN k ON k.u = m.vec_id"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as WARC archives, then read the archives back."""
    folder = fresh_path(spark, "warc")
    written = warc.write_archives(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    if written.agg(F.sum("n_records")).first()[0] is None:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = warc.read_archives(spark, folder, payloads=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
    lengths = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("stored_bytes")).distinct()
    revisits = records.filter("record_type = 'revisit'").join(lengths.hint("merge"), "refers_to").withColumn("payload_bytes", F.col("stored_bytes"))
    return records.filter("record_type = 'response'").unionByName(revisits.drop("stored_bytes"))


SQL_OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CAST(CASE WHEN page_id <> first_id THEN first_id END AS BIGINT) AS refers_to
FROM f"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return summary.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


SQL_OP6 = r"""WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS w
        FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
runs AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS w
         FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, runs.k, item_id FROM runs JOIN win ON runs.k = win.k AND runs.w = win.w),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), digests=True).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.tiktoken")).drop("text")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


SQL_OP9 = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh FROM w),
p AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
f AS (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM p),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS k FROM f) WHERE k <= n - ceil(n * 0.85) + 1),
c AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
o AS (SELECT u, v, nu, nv, count(*) AS n_both FROM c JOIN p a ON a.doc_id = u JOIN p b ON b.doc_id = v AND a.t = b.t GROUP BY ALL),
e AS (SELECT u, v FROM o WHERE 100 * n_both >= 85 * (nu + nv - n_both)),
e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e2.v, r.c FROM r JOIN e2 ON e2.u = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


SQL_OP11 = """WITH v AS (
  SELECT vec_id, len(embedding) AS d, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v
      WHERE list_dot_product(v, v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS score
      FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.d = b.d WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64)


_ASSIGNED = """a{t} AS (SELECT vec_id, x, c, d FROM (
  SELECT k.vec_id, k.x, m.c, list_sum(list_transform(list_zip(k.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
         row_number() OVER (PARTITION BY k.vec_id ORDER BY d, m.c) AS r FROM k, m{t} m) WHERE r = 1)"""
_MOVED = """m{n} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (
  SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, x FROM m{t} WHERE c NOT IN (SELECT c FROM a{t}))"""
SQL_OP12 = f"""WITH k AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT *, sha256('1:' || vec_id) AS h FROM k ORDER BY h LIMIT 16)),
{", ".join(f"{_ASSIGNED.format(t=t)}, {_MOVED.format(t=t, n=t + 1)}" for t in range(3))}, {_ASSIGNED.format(t=3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m3.x, ',')) AS centroid_sha256
FROM a3 JOIN m3 ON m3.c = a3.c"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, low=50, high=95)


SQL_OP13 = """WITH v AS (
  SELECT vec_id, len(embedding) AS d, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.d = b.d WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
      SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


QUERIES = [
    Query("op1_suffix_dedup", op1_suffix_dedup),
    Query("op2_ppm", op2_ppm),
    Query("op3_line_dedup", op3_line_dedup, SQL_OP3),
    Query("op4_cap_filters", op4_cap_filters, SQL_OP4),
    Query("op5_warc", op5_warc, SQL_OP5),
    Query("op6_decontaminate", op6_decontaminate, SQL_OP6),
    Query("op7_pieces", op7_pieces),
    Query("op8_token_counts", op8_token_counts),
    Query("op9_minhash", op9_minhash, SQL_OP9),
    Query("op10_quality", op10_quality),
    Query("op11_nearest", op11_nearest, SQL_OP11),
    Query("op12_centroids", op12_centroids, SQL_OP12),
    Query("op13_hard_negatives", op13_hard_negatives, SQL_OP13),
]
