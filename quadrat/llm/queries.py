"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, decontamination, dimension_scan, filter_audit, license_scan, ngram_join,
               packing, pii, quality_classifier, quality_rules, substring_dedup, token_files, warc)
from .shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "anomaly")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign(stored(pieces, "pieces"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc, op2_decontamination, op3_quality_rules, op4_best_fit_packing, op5_license_scan, op6_pii,
        op7_substring_dedup, op8_token_files, op9_quality_classifier, op10_ngram_join, op11_filter_audit,
        op12_conversation_repair, op13_dimension_scan)}
#: DuckDB SQL where it can express an operator.
ORACLE: dict[str, str] = {
    "op1_warc": """
        SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN strlen(h) >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 100 AND page_id > low THEN low END AS refers_to
        FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS low
              FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
    """,
    # Every document against every order: a step removes what fails its filter and
    # none of those before it.
    "op11_filter_audit": """
        WITH RECURSIVE orders(o) AS (
            SELECT '' UNION ALL
            SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
        texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
            FROM documents),
        marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        fails AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS mask
            FROM texts LEFT JOIN marks USING (doc_id)),
        masks AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM fails GROUP BY part, mask),
        steps AS (SELECT o, s, o[s:s] AS f, o[1:s - 1] AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
        counted AS (
            SELECT part, o, s, f,
                   sum(CASE WHEN regexp_matches(mask, '[' || before || f || ']') THEN 0 ELSE n END) AS kept,
                   sum(CASE WHEN contains(mask, f) AND NOT regexp_matches(mask, '[' || before || '_]') THEN n ELSE 0 END)
                       AS removed,
                   sum(CASE WHEN contains(mask, f) AND regexp_matches(mask, '[' || before || '_]') THEN n ELSE 0 END)
                       AS redundant,
                   sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN contains(mask, f) AND NOT regexp_matches(mask, '[' || before || '_]') THEN good ELSE 0 END)
                       AS good_lost,
                   sum(CASE WHEN contains(mask, f) AND NOT regexp_matches(mask, '[' || before || '_]') THEN toxic ELSE 0 END)
                       AS toxic_lost
            FROM masks, steps GROUP BY part, o, s, f)
        SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
               redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
               toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM counted
    """,
    # All edits of one row after the other, the least (cost, audit) of each state kept.
    # States: 0 nothing yet, 1 system, 2 user, 3 a pair is complete. crc32 by its table.
    "op12_conversation_repair": """
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
            FROM conversations),
        keyed AS (
            SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(range(length(k)),
                       lambda i: ascii(k[i + 1])::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])),
                       4294967295) % 20 AS f
            FROM named, t),
        harmed AS (
            SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                   CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c
            FROM keyed, (SELECT unnest([1, 2]) AS c) WHERE f <> 0 AND (c = 1 OR f = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), c) AS n
            FROM harmed),
        seen AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
                   NOT regexp_matches(text, '[^ \x09-\x0D]') AS blank,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS former
            FROM placed),
        ruled AS (
            SELECT conv_id, turn, role, text, n, blank, again AND NOT blank AS duplicate,
                   NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ \x09-\x0D]*$') AS truncated,
                   former IS NOT NULL AND former[1:1] || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal
            FROM seen),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                   count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(n) AS last
            FROM ruled GROUP BY conv_id),
        gap(a, z, cost, letters, body) AS (
            SELECT s, s, 0, '', '' FROM range(4) r(s) UNION ALL
            VALUES (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'),
                   (2, 3, 3, 'I', chr(10) || 'assistant:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
                   (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        edits AS (
            SELECT conv_id, n, a, z, cost + CASE WHEN truncated AND l <> 'D' THEN 3 ELSE 0 END AS cost, l,
                   CASE WHEN l = 'D' THEN '' ELSE chr(10) || CASE WHEN l = 'K' THEN role WHEN z = 2 THEN 'user'
                        ELSE 'assistant' END || ':' || text END AS body
            FROM ruled, (VALUES (0, 0, 4, 'D', ''), (1, 1, 4, 'D', ''), (2, 2, 4, 'D', ''), (3, 3, 4, 'D', ''),
                                (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'),
                                (2, 3, 0, 'K', 'a'), (0, 2, 3, 'R', ''), (1, 2, 3, 'R', ''), (3, 2, 3, 'R', ''),
                                (2, 3, 3, 'R', '')) e(a, z, cost, l, initial)
            WHERE l = 'D' OR NOT (blank OR duplicate) AND (l = 'R' OR role[1:1] = initial)),
        walk(conv_id, n, s, x) AS (
            SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'body': ''} FROM counted
            UNION ALL
            SELECT w.conv_id, w.n + 1, e.z, min({'cost': (w.x).cost + g.cost + e.cost,
                'audit': (w.x).audit || g.letters || e.l, 'body': (w.x).body || g.body || e.body})
            FROM walk w JOIN gap g ON g.a = w.s
            JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.n + 1 AND e.a = g.z
            GROUP BY w.conv_id, w.n, e.z),
        done AS (
            SELECT w.conv_id, min({'cost': (w.x).cost + g.cost, 'audit': (w.x).audit || g.letters,
                                   'body': (w.x).body || g.body}) AS x
            FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.last = w.n
            JOIN gap g ON g.a = w.s AND (g.z = 3 OR g.z = 0) GROUP BY w.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
               coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce((x).cost, 0)::BIGINT AS cost,
               coalesce((x).audit, '') AS audit, sha256(coalesce((x).body[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
