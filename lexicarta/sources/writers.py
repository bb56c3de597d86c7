"""Text sinks (K1-K12): each turns a frame into its lines; ``write_lines`` writes them.

Output is a folder of part files. Separators at line ends belong to the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_TERMS = 100_000


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def _heading(topic: Column, end: str) -> Column:
    return F.concat(F.lit("Topic"), topic.cast("string"), F.lit(":" + end))


def _each(items: Column, item: callable, end: str) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(item(i), F.lit(end))), "")


def document_lines(docs: DataFrame) -> DataFrame:
    """``id<TAB>text`` (K1, and K2 on training documents)."""
    return docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text").alias("value"))


def category_lines(categories: DataFrame, compat: bool = False) -> DataFrame:
    """``category<TAB>chunk<TAB>first id<TAB>text`` per category chunk, in order (K3).

    The compatible form is ``first id<TAB>text``.
    """
    first = F.col("first_id").cast("string")
    fields = [first, "text"] if compat else ["category", F.col("chunk").cast("string"), first, "text"]
    order = ["first_id"] if compat else ["category", "chunk"]
    return categories.orderBy(*order).select(F.concat_ws("\t", *fields).alias("value"))


def vector_lines(
    vectors: DataFrame, head: str = "doc_id", drop_last: bool = False, digits: int | None = None
) -> DataFrame:
    """``head i:w i:w ...`` (K4; K5 with ``head="label"``).

    ``drop_last=True`` is the compatible form without the highest term id.
    """
    entries = F.col("entries")
    if drop_last:
        entries = F.slice(entries, 1, F.greatest(F.size(entries) - 1, F.lit(0)))

    def pair(e: Column) -> Column:
        weight = (
            e["weight"].cast("string")
            if digits is None
            else F.format_string(f"%.{digits}f", F.round(e["weight"], digits))
        )
        return F.concat(e["term_id"].cast("string"), F.lit(":"), weight)

    return vectors.select(
        F.concat(F.col(head).cast("string"), F.lit(" "), _each(entries, pair, " ")).alias("value")
    )


def label_range_lines(ranges: DataFrame) -> DataFrame:
    """``category<TAB>label<TAB>start<TAB>stop`` (K6)."""
    return ranges.select(
        F.concat_ws(
            "\t",
            "category",
            *[F.col(c).cast("string") for c in ("label_id", "start_id", "stop_id")],
        ).alias("value")
    )


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    """``word<TAB>index`` (K7)."""
    return dictionary.select(
        F.concat_ws("\t", "term", F.col("term_id").cast("string")).alias("value")
    )


def document_term_lines(top: DataFrame) -> DataFrame:
    """``id<TAB>word word ...`` (K8)."""
    words = _each(F.col("top"), lambda t: t["term"], " ")
    return top.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), words).alias("value"))


def topic_document_lines(lists: DataFrame, k: int) -> DataFrame:
    """``Topic i:<TAB>[id, id, ...]`` and an empty line, for each of ``k`` topics (K9).

    A topic whose list has several parts gets one line per part.
    """
    every = lists.sparkSession.range(k).select(F.col("id").cast("int").alias("topic"))
    # Only topic numbers meet; the lists are not dealt by topic.
    unused = every.join(lists.select("topic").distinct(), "topic", "left_anti").select(
        "topic", F.lit(0).cast("bigint").alias("part"), F.lit("").alias("ids")
    )
    ids = F.array_join(F.col("doc_ids").cast("array<string>"), ", ").alias("ids")
    return (
        lists.select("topic", "part", ids)
        .unionByName(unused)
        .orderBy("topic", "part")
        .select(F.concat(_heading(F.col("topic"), "\t["), "ids", F.lit("]\n")).alias("value"))
    )


def _ranked(frame: DataFrame, *columns: str) -> DataFrame:
    """One row per topic with its ranked rows in order; at most one report long."""
    items = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    return frame.groupBy("topic").agg(items.alias("items")).orderBy("topic")


def topic_word_lines(top: DataFrame) -> DataFrame:
    """``Topic i:<TAB>word<TAB>word...`` and an empty line."""
    words = _each(F.col("items"), lambda i: i["term"], "\t")
    return _ranked(top, "term").select(
        F.concat(_heading(F.col("topic"), "\t"), words, F.lit("\n")).alias("value")
    )


def topic_top_document_lines(top: DataFrame) -> DataFrame:
    """``Topic i:<TAB>`` and one ``id:weight,`` per line."""
    pairs = _each(
        F.col("items"),
        lambda i: F.concat(i["doc_id"].cast("string"), F.lit(":"), i["weight"].cast("string")),
        ",\n",
    )
    return _ranked(top, "doc_id", "weight").select(
        F.concat(_heading(F.col("topic"), "\t"), pairs, F.lit("\n")).alias("value")
    )


def topic_description_lines(terms: DataFrame, list_terms: int = LIST_TERMS) -> DataFrame:
    """``Topic i:`` and a line with all its words.

    A topic of more than ``list_terms`` words comes in parts of that many, each with the heading,
    which follow each other by rank.
    """
    parts = (
        terms.withColumn("part", F.expr(f"(rank - 1) div {list_terms}"))
        .groupBy("topic", "part")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("items"))
        .orderBy("topic", "part")
    )
    words = _each(F.col("items"), lambda i: i["term"], " ")
    return parts.select(F.concat(_heading(F.col("topic"), "\n"), words, F.lit("\n")).alias("value"))
