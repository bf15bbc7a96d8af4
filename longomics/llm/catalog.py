"""Registered queries of this subpackage over the corpus tables, with SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, jaccard, langid, mixing, neardup, pii, quality, rules, runs, substrings, tokens, urlfilter
from .base import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_source_mix", r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
      + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM sized GROUP BY source),
levels AS (
  SELECT (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY 3 * source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least((SELECT max(level) FROM levels) * w, CAST(3 * source_size AS DOUBLE)) AS target FROM ranked),
expected AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / CAST(t.source_size AS DOUBLE), CAST(3 AS DOUBLE)) ELSE 0 END AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS sure, e - floor(e) AS p,
    CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) ELSE CAST('inf' AS DOUBLE) END AS q
  FROM expected),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto,
    sum(sure * size) OVER (PARTITION BY source) AS given
  FROM odds)
SELECT doc_id, size, source_size, target, sure + CAST(p > 0 AND 2 * upto - size <= 2 * (target - given) AS BIGINT) AS copies,
  size * (sure + CAST(p > 0 AND 2 * upto - size <= 2 * (target - given) AS BIGINT)) AS taken
FROM placed""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op4_pii_spans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


# The tables hold no lists and no fetch times: both are derived from the pages, by rule, in both engines.
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), '[.]?(:[0-9]*)?$', '')"
_EVENTS = f"""
WITH hosts AS (SELECT DISTINCT {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
val AS (
  SELECT DISTINCT concat('h:', host) AS value FROM hosts WHERE host <> ''
  UNION SELECT concat('h:', regexp_extract(host, '([^.]+[.][^.]+)$', 1)) FROM hosts WHERE regexp_extract(host, '([^.]+[.][^.]+)$', 1) <> ''
  UNION SELECT concat('p:', host, '/', seg) FROM hosts WHERE host <> '' AND seg <> ''),
hashed AS (SELECT value, ascii(substr(md5(value), 1, 1)) * 256 + ascii(substr(md5(value), 2, 1)) + ascii(substr(md5(value), 3, 1)) AS h FROM val),
listed AS (
  SELECT 'ads' AS list, value, h FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT 'malware', value, h + 7 FROM hashed WHERE h % 5 = 1
  UNION ALL SELECT 'adult', value, h + 31 FROM hashed WHERE h % 7 = 2),
events AS (
  SELECT list, value, date_add(DATE '2024-01-01', CAST(h % 200 AS INT)) AS onday, 'add' AS action FROM listed
  UNION ALL SELECT list, value, date_add(DATE '2024-01-01', CAST(h % 200 + 30 + h % 90 AS INT)), 'remove' FROM listed
  UNION ALL SELECT list, value, DATE '2024-12-01', 'add' FROM listed WHERE h % 2 = 0)
"""
_FETCHED = "date_add(DATE '2024-01-01', CAST(page_id % 366 AS INT))"
# DuckDB adds days as integers to dates.
_DUCK = lambda sql: sql.replace("date_add(DATE '2024-01-01', ", "(DATE '2024-01-01' + ")


@query("op5_url_filter", _DUCK(_EVENTS) + rf""",
dated AS (SELECT list, value, onday, max(action = 'add') AS isopen FROM events GROUP BY ALL),
spans AS (SELECT *, lead(onday) OVER (PARTITION BY list, value ORDER BY onday) AS until FROM dated),
caps AS (SELECT row_number() OVER () AS rid, page_id, {_HOST} AS host, {_DUCK(_FETCHED)} AS fetched_on,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x : x <> '') AS segs FROM caps),
offered AS (
  SELECT DISTINCT rid, fetched_on, concat('h:', array_to_string(labels[k:], '.')) AS value
  FROM parts, unnest(range(1, greatest(2, len(labels)))) AS t(k) WHERE host <> ''
  UNION SELECT rid, fetched_on, concat('p:', host, '/', array_to_string(segs[:k], '/'))
  FROM parts, unnest(range(1, len(segs) + 1)) AS t(k) WHERE host <> ''),
met AS (SELECT o.rid, o.value, s.list FROM offered o JOIN spans s ON o.value = s.value AND s.isopen
  AND s.onday <= o.fetched_on AND (s.until IS NULL OR o.fetched_on < s.until)),
decided AS (SELECT rid, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
  array_to_string(list_sort(list_distinct(list(value))), ',') AS matched FROM met GROUP BY rid)
SELECT page_id, host, fetched_on, coalesce(n, 0) AS n_entries, coalesce(n, 0) > 0 AS blocked, coalesce(lists, '') AS lists,
  coalesce(matched, '') AS matched FROM caps LEFT JOIN decided USING (rid)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_captures(pages.withColumn("fetched_on", F.expr(_FETCHED)), _listed_events(pages))


def _listed_events(pages: DataFrame) -> DataFrame:
    """The events of ``_EVENTS`` in one pass over the pages."""
    hosts = pages.select(F.expr(_HOST).alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#/]+)", 1).alias("seg")) \
        .where("host <> ''").distinct()
    domain = F.regexp_extract("host", "([^.]+[.][^.]+)$", 1)
    value = F.explode(F.array(F.concat(F.lit("h:"), F.col("host")), F.when(domain != "", F.concat(F.lit("h:"), domain)),
                              F.when(F.col("seg") != "", F.concat(F.lit("p:"), F.col("host"), F.lit("/"), F.col("seg")))))
    digest = F.md5(F.col("value").cast("binary"))
    code = lambda k: F.ascii(F.substring(digest, k, 1))
    hashed = hosts.select(value.alias("value")).where("value IS NOT NULL").distinct().withColumn("h", code(1) * 256 + code(2) + code(3))
    entry = lambda name, shift, part, rest: F.when(F.col("h") % part == rest, F.struct(F.lit(name).alias("list"), (F.col("h") + shift).alias("h")))
    listed = hashed.select("value", F.explode(F.array(entry("ads", 0, 3, 0), entry("malware", 7, 5, 1), entry("adult", 31, 7, 2))).alias("e")) \
        .where("e IS NOT NULL").select("e.list", "value", "e.h")
    start, h = F.to_date(F.lit("2024-01-01")), F.col("h")
    event = lambda day, action: F.struct(day.alias("on"), F.lit(action).alias("action"))
    events = F.array(event(F.date_add(start, h % 200), "add"), event(F.date_add(start, h % 200 + 30 + h % 90), "remove"),
                     F.when(h % 2 == 0, event(F.to_date(F.lit("2024-12-01")), "add")))
    return listed.select("list", "value", F.explode(events).alias("x")).where("x IS NOT NULL").select("list", "value", "x.on", "x.action")


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


@query("op7_benchmark_leaks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_quality_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(3, 1)
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    learned = langid.learn(docs, ~out)
    return langid.identify(docs, learned).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op10_embedding_near_dup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


_BEYOND = {rule: f"1000 * {part} {'<' if rule == 'short_words' else '>'} cutoff * {whole}" for rule, (part, whole) in rules.PARTS.items()}
_REJECTS = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {test}" for rule, test in _BEYOND.items()) + " END"
_GRID = ", ".join(f"({k}, '{rule}', {c})" for k, (rule, c) in enumerate((rule, c) for rule, cs in rules.CUTOFFS.items() for c in cs))


@query("op11_quality_rules", rf"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{rules.WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '{rules.WORD}')) AS lines
  FROM documents),
windows AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM words, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '{rules.SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (rid)),
based AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM counted),
marks AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (
  SELECT DISTINCT b.doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, good,
    ascii(md5(CAST(b.doc_id AS VARCHAR))) % 2 = 0 AS learns
  FROM based b JOIN marks m ON b.doc_id = m.doc_id WHERE NOT base_failed),
grid(k, rule, cutoff) AS (VALUES {_GRID}),
seen AS (
  SELECT k, rule, cutoff, count(*) FILTER (WHERE good AND {_REJECTS}) AS good, count(*) FILTER (WHERE NOT good AND {_REJECTS}) AS bad
  FROM grid, (SELECT * FROM labelled WHERE learns) GROUP BY k, rule, cutoff),
ordered AS (SELECT row_number() OVER (ORDER BY good, bad DESC, k) AS step, rule, cutoff FROM seen),
learned AS (SELECT l.doc_id, l.good, min(step) AS step FROM labelled l LEFT JOIN ordered ON {_REJECTS} WHERE learns
  GROUP BY l.doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, l.good),
added AS (SELECT step, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad FROM learned GROUP BY step),
path AS (
  SELECT row_number() OVER (ORDER BY step) AS pos, rule, cutoff FROM ordered JOIN added USING (step)
  WHERE bad * (SELECT sum(good) FROM added) > good * (SELECT sum(bad) FROM added)),
holdouts AS (SELECT * FROM labelled WHERE good AND NOT learns),
sizes AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata FROM holdouts GROUP BY lang),
hits AS (SELECT h.lang, min(pos) AS pos FROM holdouts h LEFT JOIN path ON {_REJECTS}
  GROUP BY doc_id, h.lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words),
losses AS (SELECT s.lang, n, strata, p.pos, count(h.pos) AS k FROM sizes s CROSS JOIN path p LEFT JOIN hits h
  ON h.lang IS NOT DISTINCT FROM s.lang AND h.pos <= p.pos GROUP BY s.lang, n, strata, p.pos),
tails AS (
  SELECT lang, pos, CASE WHEN k >= n * CAST({rules.ALPHA} AS DOUBLE) THEN true ELSE
    (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rules.ALPHA}::DOUBLE) + (n - j) * ln(1 - {rules.ALPHA}::DOUBLE)))
     FROM unnest(range(0, k + 1)) AS u(j)) > CAST({rules.DELTA} AS DOUBLE) / strata END AS fails
  FROM losses),
proofs AS (SELECT lang, coalesce(min(pos) FILTER (WHERE fails) - 1, count(*)) AS steps FROM tails GROUP BY lang),
judged AS (SELECT b.rid, min(pos) AS pos FROM based b JOIN path ON {_REJECTS} GROUP BY b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (pos IS NULL OR pos > coalesce(steps, 0)) AS kept
FROM based b LEFT JOIN judged USING (rid) LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM b.lang""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *paths)[0]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word order of a tenth of the documents, by their id: from some word on, the words after it repeat."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g, at = h // 10, np.arange(n)
    start = g % n
    return np.where(at < start, at, start + (at - start) % (1 + (n - start) // (3 + g % 8)))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(table(spark, sf_dir, "documents"), arrange=repeated_tail))
