"""Packing across rows: batches of a transcript's chunks, without its chunks ever meeting in one row or one task.

The rule is that of :func:`corvane.functions.text.pack`: in order, a group that
would pass the target is closed first, and a long unit stays whole.  It is
sequential, but all that passes from one chunk to the next is how many words the
open group holds, and once a group starts in a block of chunks, what follows
there does not depend on what came before.  So

1. each block of ``BLOCK`` chunks notes, for a group that starts at each of its
   chunks (found by bisection on the sums of words, from the last chunk back),
   what is held at its end and how many groups have started by then;
2. a fold over the blocks, a few numbers each, tells what every block is entered with;
3. every block numbers its chunks by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.functions.text import word_count
from corvane.session import ship
from corvane.sources.schemas import BATCH_WORDS

#: Chunks in a block.
BLOCK = 256


def starts(words: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sums of words; and for a group that starts at each chunk: where the next one starts (the end if nowhere), what is held at the end, groups until then."""
    sums = np.cumsum(words)
    n = len(words)
    follow = np.maximum(np.searchsorted(sums, target + sums - words, "right"), np.arange(n) + 1)
    held, groups = sums[-1] - sums + words, np.ones(n, np.int64)
    for c in range(n - 1, -1, -1):
        j = follow[c]
        if j < n:
            held[c], groups[c] = held[j], groups[j] + 1
    return sums, follow, held, groups


def first_start(sums: np.ndarray, held: int, target: int) -> int:
    """The first chunk that an open group of ``held`` words cannot take; -1 for none open."""
    return 0 if held < 0 else int(np.searchsorted(sums, target - held, "right"))


def numbered(chunks: DataFrame, *, key: str = "transcript_id", order: str = "chunk_index", words: str = "words", target: int = BATCH_WORDS, block: int = BLOCK) -> DataFrame:
    """``key, order, batch_no`` of rows with ``key, order, words``; ``order`` is without repeats in a key.

    Only numbers move.  A key with most of the rows is spread over its blocks; the
    fold reads a row for each.
    """
    ship(chunks.sparkSession)
    rows = chunks.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("i"), F.coalesce(F.col(words), F.lit(0)).cast("long").alias("w"), F.floor(F.col(order) / block).alias("b"))

    def summed(key_: tuple, table: pa.Table) -> pa.Table:
        own = table.sort_by("i").column("w").to_numpy().astype(np.int64)
        sums, _, held, groups = starts(own, target)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (sums, held, groups)]
        return pa.table([pa.array([key_[0].as_py()], pa.int64()), pa.array([key_[1].as_py()], pa.int64()), *lists], names=["k", "b", "sums", "held", "groups"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, number = object(), -1, -1
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["k"] != last:
                    last, held, number = r["k"], -1, -1
                out.append((r["k"], r["b"], held, number))
                sums = np.array(r["sums"])
                c = first_start(sums, held, target)
                if c < len(sums):
                    held, number = r["held"][c], number + r["groups"][c]
                else:
                    held += int(sums[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["k", "b", "enter", "number"])

    def assigned(table: pa.Table, entry: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        own = table.column("w").to_numpy().astype(np.int64)
        sums, follow, _, _ = starts(own, target)
        opens = np.zeros(len(own), np.int64)
        c = first_start(sums, entry.column("enter")[0].as_py(), target)
        while c < len(own):
            opens[c] = 1
            c = int(follow[c])
        return pa.table([table.column("k"), table.column("i"), pa.array(np.cumsum(opens) + entry.column("number")[0].as_py(), pa.int32())], names=["k", "i", "batch_no"])

    blocks = rows.groupBy("k", "b").applyInArrow(summed, "k long, b long, sums array<long>, held array<long>, groups array<long>")
    entries = blocks.repartition("k").sortWithinPartitions("k", "b").mapInArrow(folded, "k long, b long, enter long, number long")
    done = rows.groupBy("k", "b").cogroup(entries.groupBy("k", "b")).applyInArrow(assigned, "k long, i long, batch_no int")
    return done.select(F.col("k").alias(key), F.col("i").cast(chunks.schema[order].dataType).alias(order), "batch_no")


def batches(chunks: DataFrame, *, keys: Sequence[str] = ("transcript_id",), order: str = "chunk_index", text: str = "chunk_text", target: int = BATCH_WORDS, block: int = BLOCK) -> DataFrame:
    """``keys, batch_no, batch``: the texts of each batch in order; no row holds more than a batch.

    Several ``keys`` are numbered as one by their hash, and held apart by themselves.
    """
    counted = chunks.select(F.xxhash64(*keys).alias("_k"), *keys, order, text, word_count(F.col(text)).alias("_w"))
    number = numbered(counted, key="_k", order=order, words="_w", target=target, block=block)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(text).alias("t")))), lambda c: c["t"])
    return counted.join(number, ["_k", order]).groupBy(*keys, "batch_no").agg(listed.alias("batch"))
