"""Queries over the driver's tables, one for each text operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm import bpe, chat, decontam, html_extract, jaccard_join, lang_id, license_scan, lm_score, media, url_filters
from pixloom.llm.common import table

#: The rule list of the URL query.
URL_RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.host_rule(action, spec) for action, spec in URL_RULES]
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), [*rules, *url_filters.OWN_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("n_matches", F.size("matches").cast("long")).drop("matches")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(turns)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(lang_id.checksum("doc_id"), F.lit(3)) == 1
    model = lang_id.fit(docs.where(~held))
    return lang_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_rejected"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.transform("passages", lambda p: F.coalesce(p["item_id"].cast("string"), F.lit("null")))
    return found.select(
        "doc_id", F.array_join(names, ",").alias("item_ids"),
        F.array_max(F.transform("passages", lambda p: p["equal_words"])).alias("equal_words"),
        F.array_min(F.transform("passages", lambda p: p["first_word"])).alias("first_word"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_license_scan, op3_media_columns, op4_chat_format, op5_bpe, op6_lm_score, op7_language_id,
        op8_jaccard_join, op9_html_extract, op10_decontamination, pipeline,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_URL_SQL = f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, name, rule_host, rule_path) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
own(pattern_rule, pattern, place) AS (VALUES
  ('host:spam', '(^|[^a-z0-9_])spam([^a-z0-9_]|$)', 1), ('host:pills', '(^|[^a-z0-9_])cheap-pills([^a-z0-9_]|$)', 2),
  ('host:casino', '(^|[^a-z0-9_])casino([^a-z0-9_]|$)', 3)),
judged AS (
  SELECT cut.*, (SELECT max_by(struct_pack(name := name, action := action), length(name)) FROM rules
                 WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS hit,
         (SELECT min_by(pattern_rule, place) FROM own WHERE regexp_matches(host, pattern)) AS fallback
  FROM cut)
SELECT page_id, host, path, hit.name AS rule,
       CASE WHEN hit.action IS NOT NULL THEN hit.action WHEN fallback IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN hit.name IS NULL THEN fallback END AS pattern_rule
FROM judged
"""

# Escapes put one backslash into each control string of a text; roles here need none.
_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(regexp_replace(text,
    '<(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|unk>|pad>|<SYS>>|</SYS>>)|\[(\\*)(INST\]|/INST\])',
    '\0_', 'g')) AS shown FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + shown + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LITTLE_SQL = "printf('%02X%02X%02X%02X', ({v}) & 255, ({v}) >> 8 & 255, ({v}) >> 16 & 255, ({v}) >> 24 & 255)"

# Texts hold no whole media, so nothing is embedded.
_MEDIA_SQL = f"""
WITH cut AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
padded AS (SELECT doc_id, n, raw || encode(repeat(' ', CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END)) AS payload FROM cut),
sized AS (
  SELECT *, octet_length(payload) AS m, list_transform(regexp_extract_all(hex(payload), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS samples FROM padded),
stored AS (
  SELECT *, unhex('52494646' || {_LITTLE_SQL.format(v="m + 36")} || hex('WAVEfmt ') || '100000000100010040' || '1F0000401F000001000800' || hex('data') || {_LITTLE_SQL.format(v="m")}) || payload AS media
  FROM sized)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), samples[-16:]), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS BIGINT) AS tail_crc32,
  CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256,
  'wav;frames=' || (m // 192) || ';min=' || list_min(samples) || ';max=' || list_max(samples) || ';mean=' || printf('%.6f', CAST(list_sum(samples) AS DOUBLE) / m) || ';embedded=0' AS feature,
  'wav' AS media_type, true AS declared_ok
FROM stored
"""

_TEMPLATES_SQL = ", ".join("('{}', '{}')".format(label, text.replace("'", "''")) for label, text in license_scan.TEMPLATES)

_LICENSE_SQL = rf"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
phrases(p, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words WHERE list_contains(w, 'license')),
places AS (SELECT doc_id, k - 1 AS place, label FROM starts, phrases WHERE w[k:k + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates AS (
  SELECT label, list_distinct(ws) AS tokens, CAST(ceil(1.5::DOUBLE * len(ws)) AS BIGINT) AS size,
         CAST(ceil(0.8::DOUBLE * len(list_distinct(ws)) - 1e-9) AS BIGINT) AS least
  FROM (SELECT label, regexp_extract_all(translate(body, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM (VALUES {_TEMPLATES_SQL}) v(label, body))),
numbered AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM words),
own AS (SELECT label, size, least, len(tokens) AS m, unnest(tokens) AS word FROM templates),
met AS (SELECT doc_id, label, size, least, m, k, word FROM numbered JOIN own USING (word)),
able AS (SELECT doc_id, label FROM met GROUP BY doc_id, label HAVING count(DISTINCT word) >= any_value(least)),
here AS (SELECT met.* FROM met JOIN able USING (doc_id, label)),
blocks AS (
  SELECT a.doc_id, a.label, a.k, a.size, count(DISTINCT b.word) / CAST(any_value(a.m) AS DOUBLE) AS share
  FROM here a JOIN here b ON a.doc_id = b.doc_id AND a.label = b.label AND b.k >= a.k AND b.k < a.k + a.size
  GROUP BY a.doc_id, a.label, a.k, a.size HAVING count(DISTINCT b.word) >= any_value(a.least)),
apart AS (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY doc_id, label ORDER BY k) >= size, true) AS first FROM blocks),
method AS (SELECT doc_id, count(*) FILTER (WHERE first) AS n_matches, max(share) AS score, list(DISTINCT label) AS labels FROM apart GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  coalesce(score, 0) AS score, coalesce(n_matches, 0) AS n_matches
FROM words LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id)
"""

_JACCARD_SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM tokens),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

# Every alignment of a document and an item with enough equal words; of each the stretch from one equal word to another with
# the most of them that keeps the share (of equal ones the one that ends first); of each item the best, then the first.
_PASSAGES_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS t, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
doc_words AS (SELECT d, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
item_words AS (SELECT t, least(10, len(w)) AS least_words, unnest(w) AS word, unnest(range(len(w))) AS p FROM items),
lines AS (
  SELECT d, t, x.p - y.p AS line, any_value(least_words) AS least_words, list(x.p ORDER BY x.p) AS places
  FROM doc_words x JOIN item_words y USING (word) GROUP BY d, t, line HAVING count(*) >= any_value(least_words)),
ends AS (SELECT d, t, line, least_words, places, unnest(range(1, len(places) + 1)) AS j FROM lines),
stretches AS (
  SELECT d, t, line, least_words, places[j] AS stop,
         list_filter(range(1, j + 1), lambda i: 4 * (j - i + 1) >= 3 * (places[j] - places[i] + 1))[1] AS i, j, places FROM ends),
longest AS (
  SELECT d, t, line, least_words, arg_max({{'equal': j - i + 1, 'first': places[i]}}, (j - i + 1) * 100000000 - stop) AS best FROM stretches GROUP BY d, t, line, least_words),
named AS (
  SELECT d, item_id, arg_max(best, best.equal * 100000000 - best.first) AS best FROM longest JOIN items USING (t)
  WHERE best.equal >= least_words GROUP BY d, item_id)
SELECT doc_id, string_agg(coalesce(CAST(item_id AS VARCHAR), 'null'), ',' ORDER BY item_id NULLS FIRST) AS item_ids,
       max(best.equal) AS equal_words, min(best.first) AS first_word
FROM named JOIN docs USING (d) GROUP BY d, doc_id
"""

#: The others have no SQL: sums of logarithms (6), merges (5), training (7), tree walks (9); tests hold them
#: against brute force, round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_url_filters": _URL_SQL, "op2_license_scan": _LICENSE_SQL, "op3_media_columns": _MEDIA_SQL, "op4_chat_format": _CHAT_SQL, "op8_jaccard_join": _JACCARD_SQL,
    "op10_decontamination": _PASSAGES_SQL,
}
