"""Schemas and constants of the transcript store."""

from __future__ import annotations

from pyspark.sql import types as T

# The five dimensions in canonical order, and constants that change results.
DIMENSIONS = ("evasiveness", "sentiment_shift", "complexity_spike", "overpromising", "forward_guidance_vagueness")
FILENAME = r"^([A-Za-z0-9&]+)_(Q[1-4])_(\d{4})$"
PAGE_BREAK = "[PAGE_BREAK]"
MIN_WORDS = 50
CHUNK_WORDS = 600
BATCH_WORDS = 2000
SCORE_MIN, SCORE_MAX = 1, 10
MAX_QUOTES = 3
CONTEXT_CHARS = 40
IMPROVING_AT, DETERIORATING_AT = -1.5, 1.5
RETRIES, FIRST_BACKOFF, BACKOFF_CAP = 5, 2.0, 60.0
TEMPERATURE, MAX_TOKENS = 0.1, 800
LOGGED_CHARS = 200

# The tables' columns.
TRANSCRIPTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("quarter", T.StringType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("chunk_text", T.StringType(), False),
        T.StructField("word_count", T.IntegerType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("extracted_at", T.TimestampType(), False),
    ]
)
SCORING_RUNS = T.StructType(
    [
        T.StructField("transcript_id", T.LongType(), False),
        T.StructField("model_name", T.StringType(), False),
        T.StructField("prompt_version", T.StringType(), False),
        T.StructField("scored_at", T.TimestampType(), False),
        T.StructField("raw_llm_response", T.StringType(), False),
    ]
)
SCORES = T.StructType(
    [
        T.StructField("transcript_id", T.LongType(), False),
        T.StructField("dimension", T.StringType(), False),
        T.StructField("score", T.IntegerType(), False),
        T.StructField("supporting_quotes", T.ArrayType(T.StringType())),
        T.StructField("scored_at", T.TimestampType(), False),
        T.StructField("model_name", T.StringType(), False),
        T.StructField("prompt_version", T.StringType(), False),
        T.StructField("raw_llm_response", T.StringType(), False),
    ]
)
#: Files that an ingest left out, and why.
REJECTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("rejected_at", T.TimestampType()),
    ]
)
