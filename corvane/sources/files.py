"""Documents from files: scan, metadata, text, and the ingest plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import text as X
from corvane.operators import store
from corvane.session import ship
from corvane.sources.schemas import CHUNK_WORDS, FILENAME, MIN_WORDS, PAGE_BREAK

NAME_FORM, TOO_SHORT = "its name has another form", "it has too few words"
#: An extractor turns a file's bytes into page texts.
Extractor = Callable[[bytes], list[str]]


def plain_pages(content: bytes) -> list[str]:
    """Plain text with form feeds between pages; replaced by a PDF library's extractor where one is installed."""
    return content.decode("utf-8", "replace").split("\f")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the folder's PDF files, whatever the extension's case; see :func:`listing` for their order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content")


def listing(files: DataFrame) -> DataFrame:
    """The files' paths in order.  Texts are not moved to sort them: nothing that follows depends on the order."""
    return files.select("path").orderBy("path")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def metadata(path: Column) -> Column:
    """``company, quarter, year`` from a file name; null if it has another form."""
    name = stem(path)
    part = lambda k: F.regexp_extract(name, FILENAME, k)
    return F.when(name.rlike(FILENAME), F.struct(F.upper(part(1)).alias("company"), part(2).alias("quarter"), part(3).cast("int").alias("year")))


def texts(files: DataFrame, extract: Extractor = plain_pages) -> DataFrame:
    """Add ``text``: the pages joined by page marks."""

    ship(files.sparkSession)

    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(extract)

    return files.withColumn("text", F.array_join(pages("content"), f"\n{PAGE_BREAK}\n")).drop("content")


def split_rejects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with metadata, and those whose name has another form."""
    named = files.withColumn("meta", metadata(F.col("path")))
    return named.where("meta is not null"), named.where("meta is null").drop("meta")


def read(files: DataFrame, target: int = CHUNK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``path, meta, source_file, n_words, chunks`` of files with ``path, text``, without chunks where a file is rejected: one narrow stage, no shuffle."""
    words = X.word_count(F.col("text"))
    made = F.when(F.col("meta").isNotNull() & (words >= min_words), X.chunks(X.clean(F.col("text")), target))
    named = files.withColumn("meta", metadata(F.col("path")))
    return named.select("path", "meta", F.element_at(F.split("path", "/"), -1).alias("source_file"), words.alias("n_words"), made.alias("chunks"))


def accepted(found: DataFrame) -> DataFrame:
    return found.where("chunks is not null").select("meta.*", "source_file", "chunks")


def rejected(found: DataFrame) -> DataFrame:
    """``path, reason, n_words`` of the files that are no transcripts."""
    reason = F.when(F.col("meta").isNull(), NAME_FORM).otherwise(TOO_SHORT)
    return found.where("chunks is null").select("path", reason.alias("reason"), "n_words")


def transcripts(files: DataFrame, target: int = CHUNK_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``company, quarter, year, source_file, chunks`` of files with ``path, text``."""
    return accepted(read(files, target, min_words))


def ingest(spark: SparkSession, folder: str, path: str, extract: Extractor = plain_pages, *, rejects: str | None = None, target: int = CHUNK_WORDS, min_words: int = MIN_WORDS) -> dict[str, int]:
    """Scan, clean, chunk, and replace the transcripts at ``path``; returns documents, chunks, words and rejected files.

    Every rejected file is a row of the table ``rejects``.  Texts are extracted once.
    """
    found = store.stage(read(texts(scan(spark, folder), extract), target, min_words), path)
    try:
        totals = store.replace_transcripts(spark, path, accepted(found))
        bad = rejected(found)
        if rejects:
            bad.withColumn("rejected_at", F.current_timestamp()).write.mode("append").parquet(rejects)
        return totals | {"rejected": bad.count()}
    finally:
        store.unstage(found)


def write_clean_texts(files: DataFrame, path: str) -> None:
    """The cleaned text of each file, in a partition named by its stem."""
    files.select(X.clean(F.col("text")).alias("value"), stem(F.col("path")).alias("stem")).write.mode("overwrite").partitionBy("stem").text(path)
