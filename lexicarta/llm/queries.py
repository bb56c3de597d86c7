"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.llm import (
    alignment,
    chat_format,
    exact_dedup,
    html_extract,
    license_scan,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    warc,
    whitening,
)
from lexicarta.llm.common import table
from lexicarta.llm.labelled import held_out

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public tokenizer that the packing counts with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    forest = quality_rules.train(docs, table(spark, folder, "labels"))
    return quality_rules.judged(docs, forest).select("doc_id", "rules.*")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The slot and place of every document in the mix of all sources."""
    return mixing.placed(table(spark, folder, "documents"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scanned(table(spark, folder, "documents"))
    phrases, spans = F.col("phrases.label"), F.col("spans.label")
    ends = F.transform("phrases", lambda p: p["start"] + p["words"] - 1)
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(phrases)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(phrases, spans)), ",").alias("labels"),
        "score",
        F.array_max(ends).alias("last_phrase_end"),
    )


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "class_size", "links"
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(packing.pieces(docs, tokenizer_path(), with_ids=False)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op6_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extract.extracted(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, folder, "documents"))


#: A conversation whose texts hold marks of chat templates.
MARKED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.formatted(turns.unionByName(marked)))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    captures = warc.written(table(spark, folder, "pages"))
    return warc.resolved(warc.read(captures), warc.index(captures))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = quality_classifier.train(docs, table(spark, folder, "labels"))
    return quality_classifier.scored(docs, net).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.ACCEPT).cast("int").alias("predicted"),
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """A deviation that no long can hold, which takes very many vectors, is null."""
    found = whitening.whitened(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, folder, "documents"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(table(spark, folder, "documents"), *paths)


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_html_extract": op6_html_extract,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_warc": op9_warc,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept,
               h AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "op8_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e AS (
            SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n,
                   count(*) OVER (PARTITION BY conv_id) AS turns,
                   length(regexp_replace(text,
                       '\\|<s>|</s>|\[/?(SYS|INST|ROLE)\]|\[SAY\]|\[AS\]', 'x\0', 'g')) AS chars
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
                   AS loss_sha256,
               CAST(3 + sum(chars + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
                                    ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars,
               bool_and(CASE role WHEN 'system' THEN n = 1 AND n < turns
                                  WHEN 'user' THEN n = 1 OR before IN ('system', 'assistant')
                                  WHEN 'assistant' THEN before = 'user'
                                  ELSE false END AND (n < turns OR role = 'assistant')) IS TRUE AS valid
        FROM e
        GROUP BY conv_id
    """,
    "op9_warc": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
