"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewake.llm import audit, bpe, conversations, decontaminate, langmodel, licenses, near, prefixes, repeats, search, toxicity, urlfilter, warc
from pulsewake.runtime import scratch_path

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    confirmed = F.filter("licenses", lambda x: x.confirmed)
    families = F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x.family)))
    return found.select("doc_id", "n_paragraphs", F.array_join(families, ",").alias("families"), F.size(confirmed).cast("bigint").alias("n_confirmed"),
                        (F.size("licenses") - F.size(confirmed)).cast("bigint").alias("n_unconfirmed"))


@query("op3_repeated_passages", r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS gram
           FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT r, i FROM places WHERE gram IN (SELECT gram FROM places GROUP BY 1 HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS word FROM again),
kept AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
         FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) a
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = a.r AND g.word = a.i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.find_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_suffix_array_decontamination", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)),
hits AS (SELECT p.doc_id, p.k, p.i, v.item_id FROM places p JOIN windows v USING (k, gram)),
covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS word FROM hits) GROUP BY 1),
runs AS (SELECT doc_id, count(*) - 1 + max(k) AS length FROM (
    SELECT DISTINCT h.doc_id, h.item_id, h.k, h.i, j FROM hits h JOIN (
      SELECT item_id, i AS j, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)) q USING (item_id)
    JOIN places p ON p.doc_id = h.doc_id AND p.k = h.k AND p.i = h.i AND p.gram = q.gram AND q.k = h.k)
  GROUP BY doc_id, item_id, j - i),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
LEFT JOIN (SELECT doc_id, max(length) AS longest FROM runs GROUP BY 1) USING (doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@query("op5_stupid_backoff", r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (SELECT r, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
ones AS (SELECT b, count(*) AS n FROM tokens GROUP BY 1), own1 AS (SELECT r, b, count(*) AS n FROM tokens GROUP BY 1, 2),
twos AS (SELECT a, b, count(*) AS n FROM tokens WHERE a IS NOT NULL GROUP BY 1, 2),
own2 AS (SELECT r, a, b, count(*) AS n FROM tokens WHERE a IS NOT NULL GROUP BY 1, 2, 3),
logs AS (
  SELECT t.r, CASE
      WHEN t.a IS NULL THEN ln(greatest(o.n - w.n, 0.5) / greatest((SELECT count(*) FROM tokens) - len(x.w), 1))
      WHEN p.n > q.n THEN ln((p.n - q.n) / (c.n - d.n))
      ELSE ln(greatest(o.n - w.n, 0.5) / greatest((SELECT count(*) FROM tokens) - len(x.w), 1)) + ln(0.4) END AS s
  FROM tokens t JOIN words x USING (r) JOIN ones o ON o.b = t.b JOIN own1 w ON w.r = t.r AND w.b = t.b
  LEFT JOIN twos p ON p.a = t.a AND p.b = t.b LEFT JOIN own2 q ON q.r = t.r AND q.a = t.a AND q.b = t.b
  LEFT JOIN ones c ON c.b = t.a LEFT JOIN own1 d ON d.r = t.r AND d.b = t.a)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(total / len(w), 6) AS score
FROM words LEFT JOIN (SELECT r, sum(s) AS total FROM logs GROUP BY 1) USING (r)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return langmodel.backoff_scores(docs).select("doc_id", "n_words", F.round("score", 6).alias("score"))


@query("op6_weakly_supervised_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op7_chosen_path_near_duplicates", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op8_bloom_url_filter", r"""
WITH parts AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         [p FOR p IN string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&')
          IF p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref=')] AS params FROM pages),
spelled AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/\z', '')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END AS canonical FROM parts),
listed AS (SELECT canonical FROM spelled WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path, canonical,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1),
                CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM spelled
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.repeated_addresses(pages), URL_RULES).select("page_id", "host", "path", "canonical", "rule", "verdict")


@query("op9_warc_source", """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100',
         '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, i, 1))] FOR i IN range(1, 41)], '') AS b FROM payloads),
digests AS (SELECT page_id, n, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(b, i, 1) AS INTEGER) + 8 * CAST(substr(b, i + 1, 1) AS INTEGER) + 4 * CAST(substr(b, i + 2, 1) AS INTEGER)
         + 2 * CAST(substr(b, i + 3, 1) AS INTEGER) + CAST(substr(b, i + 4, 1) AS INTEGER), 1) FOR i IN range(1, 157, 5)], '') AS digest,
         max(page_id) OVER (PARTITION BY h) AS first FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM digests
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    found = warc.read_warc(spark, path, payload=False).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(.*)>", 1), F.lit("")).cast("bigint")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


@query("op10_branch_and_bound_top_k", """
WITH vectors AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c USING (i) WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores) WHERE r <= 20
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.integer_vectors(read(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.where("id % 20 = 0"), k=20)


@query("op11_filter_audit", r"""
WITH docs AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS INTEGER) AS mask,
         CAST(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS INTEGER) AS good,
         CAST(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS INTEGER) AS toxic FROM docs d),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a JOIN letters b ON a.b <> b.b JOIN letters c ON c.b NOT IN (a.b, b.b) JOIN letters d ON d.b NOT IN (a.b, b.b, c.b)
  JOIN letters e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS gone
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
every AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (gone | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & gone <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM every
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = audit.failures(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return audit.audit(audit.combinations(failed, read(spark, sf_dir, "labels")), "".join(audit.CONDITIONS) + audit.REPEATED)


@query("op12_grouped_prefix_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixes.similar_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op13_conversation_repair", r"""
WITH RECURSIVE bytes AS (
  SELECT *, [CAST(strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1 AS BIGINT) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1
             FOR i IN range(0, length(h) // 2)] AS b
  FROM (SELECT *, lower(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')))) AS h FROM conversations)),
faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x:
         list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), 4294967295) % 20 AS k
  FROM bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faults WHERE k <> 0),
placed AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS BIGINT) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || ':' || text)) AS i FROM damaged),
marked AS (
  SELECT *, substr(role, 1, 1) AS s, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
counts AS (
  SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || s NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY ALL),
-- a state: 0 nothing yet, 1 after the system, 2 after a user, 3 after an assistant; three steps of inserts and one of the row
states(c, i, q, cost, audit, said) AS (
  SELECT c, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '' FROM counts
  UNION ALL
  SELECT c, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) AS best FROM (
      SELECT m.c, m.i, CAST(e.q AS INTEGER) AS q, p.cost + e.cost AS cost, p.audit || e.letter AS audit, p.said || e.said AS said
      FROM (SELECT c, i, 0 AS k, q, cost, audit, said FROM states
            UNION ALL SELECT c, i, 1, CASE q WHEN 2 THEN 3 ELSE 2 END, cost + 3, audit || 'I', said || CASE q WHEN 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END FROM states
            UNION ALL SELECT c, i, 2, CASE q WHEN 2 THEN 2 ELSE 3 END, cost + 6, audit || 'II',
                      said || CASE q WHEN 2 THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END FROM states) p
      JOIN marked m ON m.c = p.c AND m.i = p.i + 1,
      LATERAL (SELECT 'D' AS letter, p.q AS q, 4 AS cost, '' AS said
               UNION ALL SELECT 'K', CASE m.s WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN m.cut THEN 3 ELSE 0 END, chr(10) || m.role || ':' || m.text
               WHERE NOT m.blank AND NOT m.again AND ((m.s = 's' AND p.q = 0) OR (m.s = 'u' AND p.q <> 2) OR (m.s = 'a' AND p.q = 2))
               UNION ALL SELECT 'R', CASE p.q WHEN 2 THEN 3 ELSE 2 END, CASE WHEN m.cut THEN 6 ELSE 3 END,
                                chr(10) || CASE p.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || m.text WHERE NOT m.blank AND NOT m.again) e))
  WHERE best = 1),
ends AS (
  SELECT s.c, s.cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         said || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END AS said
  FROM states s JOIN counts n ON n.c = s.c AND n.n = s.i),
cheapest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY cost, audit) AS best FROM ends) WHERE best = 1)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN cheapest USING (c)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.audit(conversations.damaged(rows), ids=rows)
