"""Readers for tagged record files, document lines, vectors and small tables."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.text import split_words, strip_blanks

FILE_EXTENSION = ".txt"
#: Lines of a file that are numbered and gathered together.
BLOCK_LINES = 1 << 16
BAD_LINES = 20  # unreadable lines that an error message shows


def read_lines(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``lines(file, block, pos, line)`` of every text file in a folder.

    Files are read in splits, not whole, and a split is cut into blocks of ``block_lines`` lines: ``block`` is
    the byte offset of the split and the number of the cut, and ``pos`` orders the lines inside it. So a large
    file is spread over many tasks, also a compressed one, which is read in a single split.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            in_task.alias("pos"),
            F.col("value").alias("line"),
        )
        .select(
            "file",
            F.struct("start", F.expr(f"pos div {block_lines}").alias("part")).alias("block"),
            "pos",
            "line",
        )
    )


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(category, file)`` of every text file in a folder, also of empty ones.

    The names are those of Spark's own listing, which the driver holds anyway.
    """
    names = [(name,) for name in spark.read.text(path).inputFiles()]
    files = spark.createDataFrame(names, "file string")
    return files.select(category_of(F.col("file")).alias("category"), "file")


def category_of(file: Column) -> Column:
    """A training file's category: its base name without the extension."""
    name = F.url_decode(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\+", "%2B"))
    return F.regexp_replace(name, rf"\{FILE_EXTENSION}$", "")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``docs(doc_id, text)`` from ``id<TAB>text`` lines.

    The text ends at a second tab; a line without a text gives an empty one.
    """
    fields = F.split(strip_blanks(F.col("value")), "\t")
    return spark.read.text(path).select(
        F.get(fields, F.lit(0)).cast("bigint").alias("doc_id"),
        F.coalesce(F.get(fields, F.lit(1)), F.lit("")).alias("text"),
    )


def parse_vector_lines(lines: DataFrame) -> DataFrame:
    """``vectors(doc_id, entries)`` from ``id i:w i:w ...`` lines."""
    words = split_words(F.col("value"))
    entries = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w: F.struct(
            F.substring_index(w, ":", 1).cast("int").alias("term_id"),
            F.substring_index(w, ":", -1).cast("double").alias("weight"),
        ),
    )
    return lines.select(
        F.get(words, F.lit(0)).cast("bigint").alias("doc_id"), entries.alias("entries")
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vector_lines(spark.read.text(path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``dictionary(term, term_id)`` from ``word<TAB>index`` lines."""
    fields = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(fields, F.lit(0)).alias("term"),
        F.get(fields, F.lit(1)).cast("int").alias("term_id"),
    )


def read_label_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``label_ranges(category, label_id, start_id, stop_id)``.

    Fields after the fourth are ignored. Lines whose numbers cannot be read are
    counted, and some of them shown, instead of ending the job at the first one.
    """
    fields = F.split("value", "\t")
    ranges = spark.read.text(path).select(
        "value",
        F.get(fields, F.lit(0)).alias("category"),
        F.get(fields, F.lit(1)).try_cast("int").alias("label_id"),
        F.get(fields, F.lit(2)).try_cast("bigint").alias("start_id"),
        F.get(fields, F.lit(3)).try_cast("bigint").alias("stop_id"),
    )
    unreadable = F.col("label_id").isNull() | F.col("start_id").isNull() | F.col("stop_id").isNull()
    bad = ranges.where(unreadable).select("value")
    shown = [row["value"] for row in bad.take(BAD_LINES)]
    if shown:
        raise ValueError(f"{bad.count()} label ranges with unreadable numbers, among them: {shown}")
    return ranges.drop("value")


def default_stop_words() -> list[str]:
    """Spark's own public English stop list, one word per line."""
    packaged = resources.files("lexicarta.resources").joinpath("stopwords_english.txt")
    return packaged.read_text(encoding="utf-8").splitlines()


def stop_words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``stopwords(term)``, distinct (R7): a list of one's own, or the default.

    Both have a size the planner knows, so a join broadcasts the list only when
    it is small.
    """
    if path is not None:
        return spark.read.text(path).select(F.col("value").alias("term")).distinct()
    values = ", ".join("('" + word.replace("'", r"\'") + "')" for word in default_stop_words())
    return spark.sql(f"SELECT term FROM VALUES {values} AS stopwords(term)")
