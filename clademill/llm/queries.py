"""Registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.llm import align, chat, decontam, exact_dedup, fuzzy_lines, html_extract, langid, packing, quality, resample, simhash, toxicity, warc
from clademill.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for tree, formatted, spans in zip(frame["tree"], frame["formatted"], frame["loss_spans"], strict=True):
            turns = chat.parse_turns(formatted)
            loss = "".join(chat.unescape(formatted[s["start"] : s["end"]]) for s in spans)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((tree, len(turns), _sha256(told), len(loss), _sha256(loss), len(formatted)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], table.schema)
    made = chat.conversations(chat.linear_trees(table.unionByName(extra)))
    return made.mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.classify(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(_table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_chat_format": op2_chat_format,
    "op3_fuzzy_lines": op3_fuzzy_lines,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_html_main_text": op8_html_main_text,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

#: crc32 of a blob's bytes by its table of 256 entries, made from the polynomial; DuckDB has no such function.
_CRC32 = """
        poly AS (SELECT 3988292384::BIGINT AS p),
        crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, p) ELSE c // 2 END, b)) AS of_byte FROM poly)
"""
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op11_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        word AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM d),
        win AS (SELECT doc_id, p, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        twice AS (SELECT doc_id, p FROM win WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
        s AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                     len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
                     length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS capitals,
                     len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS dotted
              FROM d LEFT JOIN covered USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 2 * n_dup_lines <= n_lines
               AND 10 * letters >= 6 * word_chars AND 2 * capitals <= letters AND 10 * bullets <= 9 * n_lines AND 10 * dotted <= 3 * n_lines AS kept
        FROM b
    """,
    "op13_importance_resampling": rf"""
        WITH {_CRC32},
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        f AS (SELECT doc_id, unnest(w) AS word FROM d),
        seen AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM f UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY word),
        hashed AS (SELECT word, s, t, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
                                                      lambda c, x: xor(c // 256, of_byte[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM seen, crc),
        cell AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
        whole AS (SELECT sum(s) AS s, sum(t) AS t FROM cell),
        gain AS (SELECT bucket, floor(1000 * ln((cell.t + 1) * (whole.s + 10000) / ((cell.s + 1) * (whole.t + 10000))))::BIGINT AS gain FROM cell, whole),
        known AS (SELECT word, gain FROM hashed JOIN gain USING (bucket)),
        mean AS (SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n FROM f JOIN known USING (word) GROUP BY doc_id),
        weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                           (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM d LEFT JOIN mean USING (doc_id)),
        scored AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed),
        able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= most THEN rank END AS rank
        FROM scored LEFT JOIN able USING (doc_id)
    """,
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
               text_sha256
        FROM h
    """,
}
