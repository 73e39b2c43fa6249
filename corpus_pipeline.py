"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes every result to the shared folder and reads it again as the next one's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import bpe, langid, minhash, mix, pii
from corvane.llm.common import materialize, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no text (null or empty), or no letter in it.

    Null and repeated ids are judged by their texts, of any length; ties of languages change no row; an empty table stays empty.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Documents without text or id stay, rows that repeat an id stay or go together; of equal texts the least id stays;
    a text of any length is compared whole; an empty table stays empty.
    """
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it give way to placeholders; ``n_chars`` follows.

    Null texts stay null; rows that repeat an id are cleaned each by its own text, of any length; of spans that overlap
    the first names the placeholder; an empty table stays empty.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document's row as often as the mix takes it.

    Documents without a word go, as they weigh nothing; a null source is a source; rows that repeat an id are taken
    alike; ties in the choice go by id; a text of any length counts with all its words; an empty table stays empty.
    """
    return mix.sample(docs, mix.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row, also of repeated and null ids; a null text has no ids, an
    empty table no rows; of equally ranked pairs the leftmost merges first; a text of any length is encoded whole."""
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(docs, *args, with_decoded=True)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("mix_sources", mixture),
    ("byte_bpe", token_ids),
]

#: SQL cannot express trained machines, sketches or merges; the tests hold the stages' rows against plain versions
#: (of the mixture the targets and the rows taken, not the choice itself).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; of the tables written on the way the last stage's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as own:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            own.drop_but_last()  # what the stage wrote for itself, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
