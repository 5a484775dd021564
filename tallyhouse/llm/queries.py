"""The registered queries of the numbered operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.llm import quality_gam, quality_rules, seed_extend, suffix_array, toxicity
from tallyhouse.llm.common import crc_fold, table, whole
from tallyhouse.llm.exact_dedup import exact_dedup
from tallyhouse.llm.html_extraction import extract
from tallyhouse.llm.mixing import mix
from tallyhouse.llm.multi_index_hashing import search
from tallyhouse.llm.packing import pack
from tallyhouse.llm.partenum import similar_components
from tallyhouse.llm.periodic_runs import find_runs, strongest
from tallyhouse.llm.phrases import collocations, phrase_counts


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of every document at 95 % of the largest entropy, no source repeated more than four times."""
    return mix(table(spark, folder, "documents"), entropy=0.95, repeats=4.0).select("doc_id", "source", "tokens", "block", "place", F.round("weight", 9).alias("weight"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), every=50, k=5)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), crc_fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_partenum(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), crc_fold("doc_id", 3) == 1
    model = quality_gam.fit(docs, table(spark, folder, "labels"), ~held)
    return quality_gam.score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    got = seed_extend.deduplicate(table(spark, folder, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    got = suffix_array.deduplicate(table(spark, folder, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, folder, "documents")))


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, by a hash of the id, the words from some place on are repeats of a stretch that starts there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(whole("text"), F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("cast(g % nullif(n, 0) as int)")).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    text = F.expr("concat_ws(' ', slice(w, 1, a), transform(sequence(a, n - 1), i -> w[a + (i - a) % p]))")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(planted_runs(table(spark, folder, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS all_tokens, sum(tokens)::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM d) AS share FROM d GROUP BY source),
l AS (SELECT list(share) AS p, count(*) AS n FROM s),
-- largest exponent whose entropy is at least 95 % of ln n; then the smallest at which no source is repeated more than 4 times
h AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
               - list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ((lo + hi) / 2) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))
               >= 0.95 * ln(n) AS ok
        FROM h, l WHERE i < 32)),
r AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) / list_min(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) > 4 AS over
        FROM r, l WHERE i < 32)),
e AS (
  SELECT greatest(
    CASE WHEN list_sum(list_transform(p, lambda x: -x * ln(x))) >= 0.95 * ln(n) THEN 1.0 ELSE (SELECT lo FROM h WHERE i = 32) END,
    CASE WHEN list_max(p) / list_min(p) <= 4 THEN 0.0 ELSE (SELECT hi FROM r WHERE i = 32) END) AS x
  FROM l),
w AS (
  SELECT source, all_tokens, pow(share, x) / sum(pow(share, x)) OVER () AS weight,
         greatest(all_tokens, round(pow(share, x) / sum(pow(share, x)) OVER () * (max(share / pow(share, x)) OVER () * sum(pow(share, x)) OVER () * sum(all_tokens) OVER ()))::BIGINT) AS budget
  FROM s, e),
b AS (SELECT *, ceil(budget / all_tokens)::INT AS blocks FROM w),
u AS (
  SELECT d.doc_id, d.source, tokens, all_tokens, budget, blocks, weight, block::INT AS block, md5(d.doc_id || ':' || block) AS o
  FROM d JOIN b USING (source), unnest(range(blocks)) AS t(block)),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY o) - tokens / 2 AS middle FROM u)
SELECT doc_id, source, tokens, block, (block + ('0x' || o[1:12])::BIGINT::DOUBLE / 281474976710656.0::DOUBLE) / (CASE WHEN budget < blocks * all_tokens THEN budget / all_tokens ELSE blocks::DOUBLE END) AS place,
       round(weight, 9) AS weight
FROM f WHERE block < blocks - 1 OR budget = blocks * all_tokens OR middle <= budget - (blocks - 1) * all_tokens
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s AS a JOIN n AS m ON m.doc_id = a.doc_id JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n AS o ON o.doc_id = b.doc_id
  WHERE 100 * least(m.n, o.n) >= 80 * greatest(m.n, o.n)
  GROUP BY a.doc_id, b.doc_id, m.n, o.n HAVING 100 * count(*) >= 80 * (m.n + o.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

# windows are cut from pieces of 256 bytes and the 199 that follow
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, 256 * k AS base, substr(h, 512 * k + 1, 910) AS s FROM (SELECT doc_id, h, unnest(range((n + 255) // 256)) AS k FROM d)),
w AS (SELECT doc_id, base + j AS i, md5(substr(s, 2 * j + 1, 400)) AS m FROM (SELECT doc_id, base, s, unnest(range(least(256, length(s) // 2 - 199))) AS j FROM c)),
again AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
steps AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) AS new FROM again),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS z
  FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) GROUP BY doc_id, g),
kept AS (
  SELECT doc_id, z AS a, lead(a, 1, n) OVER (PARTITION BY doc_id ORDER BY a) AS z
  FROM (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d) JOIN d USING (doc_id)),
texts AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (z - a))::BIGINT), '' ORDER BY a) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(texts.h)) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) JOIN texts USING (doc_id)
"""

OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM t),
g AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE words > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, unnest([split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3)]) AS phrase FROM c WHERE words = 3)
  GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * f),
cuts AS (
  SELECT lang, phrase, f AS a, 1 AS k, split_part(phrase, ' ', 1) AS before, substr(phrase, length(split_part(phrase, ' ', 1)) + 2) AS after FROM k
  UNION ALL
  SELECT lang, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM k WHERE words = 3),
s AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = before JOIN f AS y ON y.lang = cuts.lang AND y.phrase = after),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_toxicity": op5_toxicity,
    "op6_partenum": op6_partenum,
    "op7_quality_gam": op7_quality_gam,
    "op8_seed_extend": op8_seed_extend,
    "op9_html_extraction": op9_html_extraction,
    "op10_suffix_array": op10_suffix_array,
    "op11_phrases": op11_phrases,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

CHECKS: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_partenum": OP6_SQL,
    "op8_seed_extend": OP8_SQL,
    "op10_suffix_array": OP10_SQL,
    "op11_phrases": OP11_SQL,
}
