"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (
    ann, decontaminate, exact_dedup, filter_audit, line_dedup, packing, quality_fm, simhash, spelling, suffix_dedup, token_counts, toxicity,
    warc)
from churnlens.llm.common import table

#: Fixed values of the registered queries.
TOKEN_LIMIT = 1024
WINDOW = 2048
REVISIT_FROM = 0
LINE_WORDS = 50
SHINGLE_WORDS, MAX_BITS = 3, 2
TOXIC_FROM, GOOD_FROM = 0.5, 0.3
QUERY_EVERY, NEIGHBOURS = 20, 20


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_line_dedup_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_words=LINE_WORDS).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=WINDOW)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=TOXIC_FROM)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.scratch_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder, revisit_from=REVISIT_FROM)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"), words=SHINGLE_WORDS, max_bits=MAX_BITS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = token_counts.token_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.answer_budget(prefixes, TOKEN_LIMIT)


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=GOOD_FROM)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, k=NEIGHBOURS)


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_line_dedup_by_words, op2_line_dedup, op3_order_preserving_packing,
    op4_toxicity, op5_suffix_dedup, op6_warc_round_trip, op7_exact_dedup, op8_simhash_dedup, op9_token_counts, op10_quality_fm,
    op11_spelling_variants, op12_filter_interaction_audit, op13_nearest_neighbours)}

ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        seq AS (
            SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        runs AS (
            SELECT doc_id, j, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS name
            FROM seq WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
        later AS (
            SELECT doc_id, j FROM (
                SELECT doc_id, j, row_number() OVER (PARTITION BY name ORDER BY doc_id, j) AS nth FROM runs WHERE name IS NOT NULL)
            WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, j + k AS j FROM later, (SELECT unnest([0, 1, 2]) AS k)),
        marked AS (
            SELECT s.doc_id, s.pos, g.j IS NOT NULL AS is_gone,
                   g.j IS NOT NULL AND NOT coalesce(lag(g.j IS NOT NULL) OVER (PARTITION BY s.doc_id ORDER BY s.j), false) AS begins
            FROM seq s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.j = g.j)
        SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE m.is_gone) AS n_removed,
               count(*) FILTER (WHERE m.begins) AS n_spans,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE NOT coalesce(m.is_gone, false)), '')) AS kept_sha256
        FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.pos = m.pos GROUP BY l.doc_id""",
    "op2_line_dedup_by_words": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        seq AS (
            SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
                   row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j, count(*) OVER (PARTITION BY doc_id) AS n
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        runs AS (
            SELECT doc_id, j, 1 AS length, line AS name, words >= 50 OR n = 1 AS due FROM seq
            UNION ALL
            SELECT doc_id, j, 2, line || chr(10) || lead(line) OVER o, words + lead(words) OVER o >= 50 OR n = 2
            FROM seq WINDOW o AS (PARTITION BY doc_id ORDER BY j)
            UNION ALL
            SELECT doc_id, j, 3, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o, true
            FROM seq WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
        later AS (
            SELECT doc_id, j, length FROM (
                SELECT doc_id, j, length, due, row_number() OVER (PARTITION BY length, name ORDER BY doc_id, j) AS nth
                FROM runs WHERE name IS NOT NULL)
            WHERE nth > 1 AND due),
        gone AS (SELECT DISTINCT doc_id, j + k AS j FROM later, (SELECT unnest([0, 1, 2]) AS k) WHERE k < length),
        marked AS (
            SELECT s.doc_id, s.pos, g.j IS NOT NULL AS is_gone,
                   g.j IS NOT NULL AND NOT coalesce(lag(g.j IS NOT NULL) OVER (PARTITION BY s.doc_id ORDER BY s.j), false) AS begins
            FROM seq s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.j = g.j)
        SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE m.is_gone) AS n_removed,
               count(*) FILTER (WHERE m.begins) AS n_spans,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE NOT coalesce(m.is_gone, false)), '')) AS kept_sha256
        FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.pos = m.pos GROUP BY l.doc_id""",
    "op6_warc_round_trip": r"""
        WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM rows),
        ranked AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM hashed)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + CAST(i // 4 AS INT) * 5, 5))::INT >> CAST(5 * (3 - i % 4) AS INT)) & 31), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM ranked""",
    "op7_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM rows WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
            FROM documents),
        counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
        hashed AS (
            SELECT run, c, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
                       lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INT)]), 4294967295), 4294967295) AS h
            FROM counted, crc),
        typed AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c
            FROM hashed),
        vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
                FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM vocab)),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, min_by(other, (-n, encode(other))) AS other, max(n) AS other_n FROM near GROUP BY word),
        formed AS (
            SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * v.n THEN b.other END AS form,
                   CASE WHEN b.other_n >= 2 * v.n THEN b.other_n END AS form_n
            FROM vocab v LEFT JOIN best b ON v.word = b.word),
        walk AS (
            SELECT word, word AS at FROM formed
            UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.at AS root
        FROM formed f JOIN walk w ON f.word = w.word JOIN formed e ON w.at = e.word WHERE e.form IS NULL""",
    "op12_filter_interaction_audit": r"""
        WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
        marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        words AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM rows),
        failed AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
                    'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
                    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS fails
            FROM words LEFT JOIN marks USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders),
        masks AS (
            SELECT part, good, toxic, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END)
                   || (CASE WHEN fails.C THEN 'C' ELSE '' END) || (CASE WHEN fails.D THEN 'D' ELSE '' END)
                   || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS mask, count(*) AS n
            FROM failed GROUP BY ALL),
        cases AS (
            SELECT part, filter_order, step, n, good, toxic, mask, substr(filter_order, step, 1) AS letter,
                   contains(mask, substr(filter_order, step, 1)) AS hit,
                   len(list_intersect(string_split(mask, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0
                       AND mask <> '' AND step > 1 AS gone
            FROM masks, steps),
        sums AS (
            SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept,
                   coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant,
                   coalesce(sum(n) FILTER (WHERE mask = letter), 0) AS unique_fails,
                   coalesce(sum(n) FILTER (WHERE hit AND NOT gone AND good), 0) AS good_lost,
                   coalesce(sum(n) FILTER (WHERE hit AND NOT gone AND toxic), 0) AS toxic_lost
            FROM cases GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM sums""",
}
