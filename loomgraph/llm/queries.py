"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, scratch, simhash, toxicity, url_filter, warc

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sha256(values: Column) -> Column:
    return F.sha2(F.array_join(values, ",").cast("binary"), 256)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write_warc(warc.pages_to_records(table(spark, sf_dir, "pages")), path)
    back = warc.reconstruct(*warc.store(warc.read_warc(spark, path)))
    sha1 = F.sha1("block")
    sound = F.when((F.col("record_type") == "revisit") | (F.concat(F.lit("sha1:"), sha1) == F.col("stated_digest")), sha1).otherwise(F.raise_error(F.lit("a payload is not what its record states")).cast("string"))
    # Names and digests are small; the payloads stay behind.
    facts = scratch.cut(back.select("record_id", "record_type", "refers_to", F.octet_length("block").cast("long").alias("payload_bytes"), sound.alias("payload_digest")), "facts")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1).try_cast("long")
    first = facts.where("record_type = 'response'")
    target = first.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = facts.where("record_type = 'revisit'").select("record_id", "record_type", "refers_to").join(target, "refers_to")
    return first.unionByName(again).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = {"ranks_path": str(public_tokenizers.path(RANKS)), "pattern": public_tokenizers.PATTERN}
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), **how), **how)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(F.col("ids").cast("array<string>")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), _sha256(names).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = language_id.training_texts(docs.where(~held_out()))
    found = language_id.identify(docs, texts)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_bpe, op3_decontamination, op4_url_filter, op5_simhash, op6_html_text, op7_toxicity, op8_language_id, op9_line_dedup, op10_embedding_dedup)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     q AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
                  max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM q""",
    "op3_decontamination": f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, w[s:s + 7] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(win) AS k FROM win),
     dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     dwin AS (SELECT doc_id, k, s, w[s:s + k - 1] AS win FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM dw, sizes WHERE len(w) >= k)),
     hit AS (SELECT DISTINCT d.doc_id, d.s, d.k, win.item_id FROM dwin d JOIN win ON d.win = win.win),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     v AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS r FROM u),
     w AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  substr(r, length(regexp_extract(r, '^[^/]*')) + 1) AS path FROM v),
     rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
     m AS (SELECT w.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
           FROM w JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY w.page_id)
SELECT w.page_id, w.host, w.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM w LEFT JOIN m USING (page_id)""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
     k AS (SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM l),
     c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> last_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     s AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(e, lambda c: c * c)) > 0),
     p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
     r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
     g AS (SELECT a, min(b) AS low FROM r GROUP BY a),
     n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(least(v.vec_id, coalesce(g.low, v.vec_id)) AS BIGINT) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(g.low, v.vec_id)) AS kept
FROM v LEFT JOIN g ON g.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
}
