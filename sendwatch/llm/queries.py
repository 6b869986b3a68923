"""Thin queries ``opN_<name>``: each applies one operator, with production
parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendwatch.llm import (decontam, divergence, huffman, langid, mixing, neardup, pieces, quality, separators,
                            sharding, spelling, urls, warc)
from sendwatch.llm.common import scratch_dir, table


def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html", min_bytes=100)
    return warc.read(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        "refers_to")


def op2_url_words_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long"))
    return urls.judge(pages, "url", "html", keep=["page_id"])


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged, _ = quality.judge(docs, "text", keep=["doc_id"])
    q = [F.col(f"quality.{k}").alias(k) for k in
         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")]
    return judged.select("doc_id", *q)


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document, read back from flat files by the end-of-document id."""
    end_id = 49407  # fixed value: <|endoftext|> of the vocabulary
    written = separators.write(table(spark, sf_dir, "documents"), "doc_id", "text", scratch_dir(spark, "flat"),
                               public_tokenizers.path("word_bpe_49k.json"), end_id)
    counts = separators.scan(written.select("uri").distinct(), "<u2", end_id)
    return written.join(counts, ["uri", "place"]).select("doc_id", "n_tokens")


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), langid.held_out(F.col("doc_id")).alias("held_out"),
        "text", "lang")
    prototypes = langid.train(docs.filter(~F.col("held_out")), "text", "lang")
    return langid.predict(docs, "text", prototypes, keep=["doc_id", "held_out"])


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "huffman")
    huffman.write(table(spark, sf_dir, "documents"), "doc_id", "text", folder,
                  public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return huffman.read_crc32(spark, folder)


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), "doc_id", "text",
                            table(spark, sf_dir, "benchmark"), "item_id", "text").drop("node")


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    out = sharding.assign(rows, ["doc_id", "size", "text_crc32"], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), "doc_id", "text",
                          public_tokenizers.path("piece_bpe_32k.model"))


def op11_fp_tree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, terms = divergence.audit(table(spark, sf_dir, "documents"))
    return (pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", "rank"))


def op12_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", keep={"doc_id": "doc_id"},
                      weights=(5, 2, 1), share=1.5, epochs=2).select("doc_id", "size", "source_size", "target", "taken")


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), "doc_id", "text") \
        .select("word", "form", "root", "n", "n_near", "form_n")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh
  FROM w
), sets AS (
  SELECT min(doc_id) AS rep, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY ALL
), e AS (
  SELECT rep, n, unnest(sh) AS g FROM sets
), common AS (
  SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS k
  FROM e x JOIN e y ON x.g = y.g AND x.rep <> y.rep GROUP BY ALL
), link AS (
  SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)
), reach AS (
  SELECT rep AS a, rep AS b FROM sets
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), label AS (
  SELECT a AS rep, min(b) AS component FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
       coalesce(label.component, s.doc_id) AS component_id,
       s.doc_id = coalesce(label.component, s.doc_id) AS kept
FROM s LEFT JOIN sets ON sets.sh = list_sort(s.sh) LEFT JOIN label ON label.rep = sets.rep
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents
), b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM benchmark
), item AS (
  SELECT item_id, ws, least(5, len(ws)) AS k, len(ws) - least(5, len(ws)) + 1 AS w FROM b WHERE len(ws) > 0
), item_shingle AS (
  SELECT item_id, k, w, s, count(*) AS c
  FROM (SELECT item_id, k, w, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, w + 1)]) AS s FROM item)
  GROUP BY ALL
), doc_shingle AS (
  SELECT doc_id, k, len(ws) - k + 1 AS wd, unnest([{'p': i - 1, 's': array_to_string(ws[i:i + k - 1], ' ')}
                            FOR i IN range(1, len(ws) - k + 2)], recursive := true)
  FROM d, (SELECT DISTINCT k FROM item) WHERE len(ws) >= k
), place AS (
  SELECT DISTINCT doc_id, item_id, doc_shingle.k, w, wd, unnest(range(p - w + 1, p + 1)) AS start
  FROM doc_shingle JOIN item_shingle USING (k, s)
), weight AS (
  SELECT place.doc_id, place.item_id, place.w, place.wd, start, doc_shingle.s, count(*) AS c
  FROM place JOIN doc_shingle ON doc_shingle.doc_id = place.doc_id AND doc_shingle.k = place.k
       AND doc_shingle.p BETWEEN start AND start + place.w - 1
  WHERE start >= 0 GROUP BY ALL
), total AS (
  SELECT doc_id, weight.item_id, weight.w, wd, start, sum(weight.c) AS n, sum(least(weight.c, coalesce(i.c, 0))) AS common
  FROM weight LEFT JOIN item_shingle i ON i.item_id = weight.item_id AND i.s = weight.s GROUP BY ALL
), hit AS (
  -- a document shorter than the item is one window, the whole of it
  SELECT *, common / (n + w - common) AS similarity FROM total
  WHERE (n = w OR (wd < w AND start = 0)) AND 100 * common >= 80 * (n + w - common)
)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start AS BIGINT) AS start FROM hit
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), e AS (
  SELECT id, lang, source, unnest(ts) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM e GROUP BY ALL HAVING count(DISTINCT id) >= 3
), l AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), c AS (
  SELECT e.lang, source, e.term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang)
       LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pair AS (
  SELECT s.lang, s.source, o.source AS item, coalesce(any_value(f.value), 0)::BIGINT AS value
  FROM s JOIN s o ON o.lang = s.lang AND o.source <> s.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
         ON f.lang = s.lang AND f.source = s.source AND f.item = o.source
  GROUP BY ALL
), part AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM part
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (  -- in order of cap to weight; with the first k sources clamped, a unit of weight gets rest / open
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2 * coalesce(sum(source_size) OVER w, 0) AS rest,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS open,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (  -- the first source that is not above its cap
  SELECT * FROM o WHERE 2 * source_size * open >= weight * rest ORDER BY place LIMIT 1
), goal AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.place >= level.place THEN o.weight * level.rest / level.open ELSE 2.0 * o.source_size END AS target
  FROM o LEFT JOIN level ON true
), ordered AS (
  SELECT d.doc_id, d.size, goal.source_size, goal.target, CASE WHEN goal.source_size > 0
         THEN floor(goal.target / goal.source_size) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY hash
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size AND size > 0
                            THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_chain": op1_warc_chain,
        "op2_url_words_bayes": op2_url_words_bayes,
        "op3_weak_supervision": op3_weak_supervision,
        "op4_minhash_bayes": op4_minhash_bayes,
        "op5_separator_scan": op5_separator_scan,
        "op6_hyperdimensional": op6_hyperdimensional,
        "op7_huffman_ids": op7_huffman_ids,
        "op8_simhash_windows": op8_simhash_windows,
        "op9_feistel_sharding": op9_feistel_sharding,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_fp_tree_divergence": op11_fp_tree_divergence,
        "op12_capped_water_filling": op12_capped_water_filling,
        "op13_pivotal_grams": op13_pivotal_grams,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_chain": OP1_SQL,
        "op4_minhash_bayes": OP4_SQL,
        "op8_simhash_windows": OP8_SQL,
        "op11_fp_tree_divergence": OP11_SQL,
        "op12_capped_water_filling": OP12_SQL,
    }
