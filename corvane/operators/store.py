"""The store: look-ups, versioned replacement, append and upsert on Parquet.

Transcripts are kept as versions.  An ingest writes its chunks into a folder of
its own and then commits, by one rename, which version each of its transcripts
is at.  Readers follow the last commit of each transcript, so they see its old
chunks or its new ones, whole; an ingest that dies before its commit leaves
nothing that is read.  Chunk ids derive from the transcript's key and its whole
text: the same text again keeps its scores, another text leaves them orphaned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corvane.functions.text import word_count
from corvane.sources.schemas import DIMENSIONS, SCORES, SCORING_RUNS, TRANSCRIPTS

KEY = ("company", "quarter", "year")
#: Folders that the table of scores is dealt to.
BUCKETS = 64


@dataclass(frozen=True)
class Paths:
    """Where the store's tables are; ``results`` holds a folder for each scoring run, ``calls`` a run's responses while it lasts."""

    transcripts: str
    scores: str
    runs: str
    results: str
    calls: str
    trends: str

    @classmethod
    def under(cls, folder: str) -> Paths:
        return cls(*(f"{folder.rstrip('/')}/{name}" for name in ("transcripts", "scores", "scoring_runs", "scoring_results", "scoring_calls", "trends")))


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one if nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


VERSIONED = T.StructType([*TRANSCRIPTS.fields, T.StructField("version", T.StringType())])
#: What a commit says of a transcript: its version, and how many chunks that has.
POINTERS = T.StructType([*(TRANSCRIPTS[c] for c in KEY), T.StructField("version", T.StringType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("commit", T.LongType())])


def latest_versions(spark: SparkSession, path: str) -> DataFrame:
    """``company, quarter, year, version, n_chunks`` of each transcript, by its last commit."""
    pointers = table(spark, f"{path}/commits", POINTERS)
    return pointers.groupBy(*KEY).agg(F.max_by(F.struct("version", "n_chunks"), "commit").alias("v")).select(*KEY, "v.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of every transcript as last committed.

    The filters of a look-up reach both the pointers and the scan's folders.
    """
    data = table(spark, f"{path}/data", VERSIONED)
    return data.join(latest_versions(spark, path), [*KEY, "version"], "left_semi").select(TRANSCRIPTS.fieldNames())


def restrict(frame: DataFrame, company: str | None = None, quarter: str | None = None, year: int | None = None) -> DataFrame:
    """Equality filters; an empty value means no filter.  They reach the scan."""
    wanted = [F.col(c) == v for c, v in (("company", company and company.upper()), ("quarter", quarter), ("year", year)) if v]
    return frame.where(reduce(lambda a, b: a & b, wanted)) if wanted else frame


def get_chunks(transcripts: DataFrame, company: str, quarter: str | None = None, year: int | None = None) -> DataFrame:
    return restrict(transcripts, company, quarter, year).orderBy("year", "quarter", "chunk_index")


def with_scores(scores: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Scores beside the transcript whose first chunk they name; scores of replaced chunks fall away."""
    keys = transcripts.select(F.col("id").alias("transcript_id"), *KEY)
    return scores.join(keys, "transcript_id")


def bucket_of(transcript_id: Column) -> Column:
    """The folder of a transcript's scores."""
    return F.pmod(F.xxhash64(transcript_id), F.lit(BUCKETS)).cast("int")


def get_scores(scores: DataFrame, transcripts: DataFrame, company: str, quarter: str | None = None, year: int | None = None) -> DataFrame:
    """The scores of the transcripts that fit, in order.

    Scores name a transcript by its first chunk, so the wanted ids tell which
    folders of the stored table to read: one for one transcript, at most ``BUCKETS``.
    """
    first = transcripts.where("chunk_index = 0") if "chunk_index" in transcripts.columns else transcripts
    wanted = restrict(first, company, quarter, year)
    if "bucket" in scores.columns:
        folders = [r[0] for r in wanted.select(bucket_of(F.col("id"))).distinct().collect()]
        scores = scores.where(F.col("bucket").isin(folders))
    return with_scores(scores, wanted).select(*KEY, "dimension", "score", "supporting_quotes", "model_name", "scored_at").orderBy("year", "quarter", "dimension")


def unique_transcripts(transcripts: DataFrame, company: str | None = None) -> DataFrame:
    return restrict(transcripts, company).select(*KEY).distinct().orderBy("company", "year", "quarter")


def years(transcripts: DataFrame, company: str) -> DataFrame:
    return restrict(transcripts, company).select("year").distinct().orderBy("year")


def sample_transcript(transcripts: DataFrame, company: str | None = None, quarter: str | None = None, year: int | None = None) -> DataFrame:
    """The first that fits, in order of company, year and quarter."""
    return restrict(transcripts, company, quarter, year).select(*KEY).distinct().orderBy("company", "year", "quarter").limit(1)


def assemble(transcripts: DataFrame) -> DataFrame:
    """Each transcript's first id and its chunk texts in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"])
    return transcripts.groupBy(*KEY).agg(F.min_by("id", "chunk_index").alias("transcript_id"), ordered.alias("chunks"))


def with_transcript_id(transcripts: DataFrame) -> DataFrame:
    """Add ``transcript_id``, the id of the transcript's first chunk, to each chunk."""
    first = transcripts.groupBy(*KEY).agg(F.min_by("id", "chunk_index").alias("transcript_id"))
    return transcripts.join(first, list(KEY))


def fully_scored(scores: DataFrame, transcripts: DataFrame, n: int = len(DIMENSIONS)) -> DataFrame:
    return with_scores(scores, transcripts).groupBy(*KEY).agg(F.countDistinct("dimension").alias("n_dimensions")).where(F.col("n_dimensions") == n)


def skip_existing(transcripts: DataFrame, done: DataFrame) -> DataFrame:
    return transcripts.select(*KEY).distinct().join(done.select(*KEY), list(KEY), "left_anti")


def latest_writes(writes: DataFrame, keys: tuple[str, ...] = ("transcript_id", "dimension"), order: tuple[str, ...] = ("scored_at", "write_seq")) -> DataFrame:
    """Of the rows with one key the last written: an upsert's result."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return writes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def stage(frame: DataFrame, beside: str) -> DataFrame:
    """``frame`` written once in a folder of its own beside a table, and read again: what it costs is paid once."""
    path = f"{beside.rstrip('/')}.staged/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(staged: DataFrame) -> None:
    """Delete what :func:`stage` wrote, once nothing reads it any more."""
    for file in staged.inputFiles()[:1]:
        delete(staged.sparkSession, file.rpartition("/")[0])


def upsert_scores(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Rows of ``new`` replace those with the same transcript and dimension.

    The table is dealt to ``BUCKETS`` folders by transcript; only those that
    ``new`` touches are read and written, each replaced when all are written.
    """
    staged = stage(new.select(*SCORES.fieldNames()), path)
    fresh = staged.withColumn("bucket", bucket_of(F.col("transcript_id")))

    def latest(old: DataFrame) -> DataFrame:
        both = old.withColumn("write_seq", F.lit(0)).unionByName(fresh.withColumn("write_seq", F.lit(1)))
        return latest_writes(both, order=("write_seq", "scored_at")).drop("write_seq")

    rewrite(spark, path, SCORES, fresh.select("bucket"), latest)
    unstage(staged)


def rewrite(spark: SparkSession, path: str, schema: T.StructType, touched: DataFrame, renew: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the folders (column ``bucket``) that ``touched`` names by ``renew`` of their rows, when all are written."""
    folders = [r[0] for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
    if folders:
        old = table(spark, path, T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
        fresh = renew(old.where(F.col("bucket").isin(folders)))
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_runs(path: str, runs: DataFrame) -> None:
    runs.select(*SCORING_RUNS.fieldNames()).write.mode("append").parquet(path)


def chunk_rows(documents: DataFrame) -> DataFrame:
    """``company, quarter, year, source_file, chunks`` to a row for each chunk; ids derive from the key and the whole text."""
    content = F.xxhash64(*KEY, "source_file", "chunks")
    rows = documents.select(*KEY, "source_file", content.alias("content"), F.posexplode("chunks").alias("chunk_index", "chunk_text"))
    return rows.select(
        F.xxhash64("content", "chunk_index").alias("id"), *KEY, "chunk_index", "chunk_text", word_count(F.col("chunk_text")).alias("word_count"), "source_file", F.current_timestamp().alias("extracted_at")
    ).select(TRANSCRIPTS.fieldNames())


def commit(pointers: DataFrame, path: str) -> int:
    """Make ``pointers`` (key, version, n_chunks) the last word on their transcripts, by one rename; returns the commit's number.

    Two ingests at once get different numbers: who finds a number taken takes the next.
    """
    spark, jvm = pointers.sparkSession, pointers.sparkSession._jvm
    place, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    staged, folder = place(f"{path}.staged/{uuid.uuid4().hex}"), place(f"{path}/commits")
    pointers.select([f for f in POINTERS.fieldNames() if f != "commit"]).write.parquet(staged.toString())
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    taken = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("commit=")]
    number = max(taken, default=0) + 1
    while True:
        try:
            files.rename(staged, place(f"{path}/commits/commit={number}"), none)
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            number += 1


def replace_transcripts(spark: SparkSession, path: str, documents: DataFrame) -> dict[str, int]:
    """Replace all transcripts in ``documents``; one without chunks is cleared.

    ``documents``, whose texts may come from extraction, are computed once.
    Returns the run's totals: documents, chunks and words.
    """
    parts, version = ("company", "year", "quarter"), uuid.uuid4().hex
    documents = stage(documents.select(*KEY, "source_file", "chunks"), path)
    try:
        rows = chunk_rows(documents)
        # a partition is one transcript, so none is large
        rows.repartition(*parts).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", *parts).parquet(f"{path}/data")
        sizes = documents.groupBy(*KEY).agg(F.sum(F.greatest(F.size("chunks"), F.lit(0))).cast("int").alias("n_chunks"))
        commit(sizes.withColumn("version", F.lit(version)), path)
        return ingest_totals(documents)
    finally:
        unstage(documents)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the chunks of versions that no transcript is at any more; for times without readers or ingests.  Returns how many went."""
    parts, gone = ("version", "company", "year", "quarter"), 0
    old = table(spark, f"{path}/data", VERSIONED).select(*parts).distinct().join(latest_versions(spark, path), [*KEY, "version"], "left_anti")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in old.toLocalIterator():  # partition names only, one at a time
        gone += fs.delete(hadoop(f"{path}/data/" + "/".join(f"{c}={r[c]}" for c in parts)), True)
    return gone


def ingest_totals(documents: DataFrame) -> dict[str, int]:
    """How many documents, chunks and words there are."""
    words = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + word_count(c))
    one = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"), F.coalesce(F.sum(words), F.lit(0)).alias("words"))
    return one.first().asDict()
