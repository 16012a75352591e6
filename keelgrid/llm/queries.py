"""The operators as queries over the whole tables, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelgrid.llm import decontam, langid, linededup, negatives, packing, phrases, quality, secrets, simhash, tokenstore, urlfilter, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "line_count", "removed_lines")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), metadata=("n_chars",))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_edited(_table(spark, sf_dir, "documents"), k=winnow.CHAR_K, window=winnow.CHAR_WINDOW, chars=True)
    return found.withColumns({c: winnow.as_digest(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.TokenStore.write(_table(spark, sf_dir, "documents")).documents(with_ids=False)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, lambda i: i % negatives.EVERY == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_line_dedup, op3_quality, op4_winnowing, op5_url_filter, op6_simhash, op7_warc, op8_decontamination, op9_language_id, op10_token_store, op11_secrets, op12_phrases, op13_hard_negatives)
}

#: Operators that SQL cannot say are tested against plain versions in tests/llm instead.
ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM d WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos] || chr(10) || ls[pos + 1] || chr(10) || ls[pos + 2] AS win FROM p
      WHERE trim(ls[pos], ' ') <> '' OR trim(ls[pos + 1], ' ') <> '' OR trim(ls[pos + 2], ' ') <> ''),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
         FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos WHERE c.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.ls), 0) AS BIGINT) AS line_count, CAST(coalesce(len(d.ls), 0) - CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(k.n, 0) END AS BIGINT) AS removed_lines
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to FROM r""",
    "op8_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS w
        FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n),
texts AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM places),
found AS (SELECT t.doc_id, t.i, t.n, win.item_id FROM texts t JOIN win ON win.w = t.w AND win.n = t.n),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hits ON hits.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id""",
    "op12_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
places AS (SELECT lang, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(s) WHERE len(ws) >= s),
f AS (SELECT lang, s AS words, array_to_string(ws[i : i + s - 1], ' ') AS phrase, count(*) AS n FROM places GROUP BY ALL),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE words > 1 AND n >= 10),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
cuts AS (SELECT k.*, p.n AS l, q.n AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(p.n AS HUGEINT) * q.n) AS score
         FROM k JOIN f p ON p.lang = k.lang AND p.phrase = array_to_string(k.ws[1 : k], ' ') JOIN f q ON q.lang = k.lang AND q.phrase = array_to_string(k.ws[k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, array_to_string(ws[i : i + 1], ' ') AS phrase, a FROM (SELECT lang, ws, a, unnest([1, 2]) AS i FROM c WHERE words = 3)),
longer AS (SELECT lang, phrase, max(a) AS a FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
r AS (SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
