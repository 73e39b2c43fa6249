"""Document fingerprints: canonical exact digests (DataFrame functions only).

Canonical form: Unicode normalisation (NFKC) and case folding, both by the ICU
library that Spark ships, every run of white space to one space,
none at the ends.  Two seeded 64-bit xxhashes of the canonical bytes make a
128-bit bucket.  Inside every bucket of more than one text the bytes themselves
are compared; texts that differ in one bucket get different suffixes, so two
fingerprints are equal exactly if the canonical texts are.

Likeness of two fingerprints is 1 if they are equal, else 0: the method is an
exact digest.  Null texts count as empty, and the empty text has a fingerprint
as any other; null ids come last in descending order; repeated rows have equal
fingerprints; of rows that share an id the one with the least hash comes first; a
very long text is normalised whole, in the task that holds its row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.common import BROADCAST_BYTES, materialize, range_cuts, semi


#: Characters of a bucket of :func:`with_next` on average, at most.
BUCKET_CHARS = 16 << 20


def canonical(text: Column) -> Column:
    """NFKC, folded case, single spaces.  Folding can undo a composition, so it is normalised again.  Of ASCII text, folding is lower-casing."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    plain = F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]"), nfkc(folded(nfkc(F.coalesce(text, F.lit("")))))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(F.coalesce(plain, F.lit("")), r"(?U)\s+", " "))


def digests(text: Column) -> list[Column]:
    """The wide hash: two 64-bit hashes with different seeds."""
    return [F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)]


def _name(first: str, second: str, rank: str) -> Column:
    wide = F.format_string("%016x%016x", F.col(first), F.col(second))
    return F.when(F.coalesce(F.col(rank), F.lit(0)) > 0, F.concat(wide, F.lit("-"), F.col(rank).cast("string"))).otherwise(wide)


def _ranks(hashed: DataFrame, texts_of) -> DataFrame:
    """``_h1, _h2, _row, _kind, _rank`` of the rows whose bucket holds different texts.

    ``hashed`` has a narrow row for each text; ``texts_of(rows)`` adds the
    canonical text to some of them.  Buckets are compared by their least and
    greatest text, which partial aggregation brings together without ever
    gathering a bucket; only buckets that truly collide are ranked.
    """
    shared = materialize(hashed.groupBy("_h1", "_h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    rows = materialize(hashed.join(shared, ["_h1", "_h2"], "left_semi"), "bucket-rows")
    texts = texts_of(rows)
    collided = texts.groupBy("_h1", "_h2").agg(F.min("_canonical").alias("_a"), F.max("_canonical").alias("_b")).where("_a <> _b").select("_h1", "_h2")
    collided = materialize(collided, "collisions")
    if collided.isEmpty():
        return rows.limit(0).withColumn("_rank", F.lit(0))
    differing = texts_of(rows.join(collided, ["_h1", "_h2"], "left_semi"))
    variants = differing.select("_h1", "_h2", "_canonical").distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_canonical")) - 1)
    return differing.join(variants, ["_h1", "_h2", "_canonical"]).drop("_canonical")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashes=digests) -> DataFrame:
    """``doc_id, fingerprint`` of each row: equal exactly for texts with equal canonical forms."""
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("_canonical"))
    h1, h2 = hashes(F.col("_canonical"))
    hashed = materialize(rows.select("doc_id", F.lit(0).alias("_kind"), h1.alias("_h1"), h2.alias("_h2")), "digests")

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = semi(rows.where("doc_id is not null"), some.select("doc_id").distinct(), "doc_id").unionByName(rows.where("doc_id is null"))
        h1, h2 = hashes(F.col("_canonical"))
        wanted = wanted.withColumns({"_h1": h1, "_h2": h2})
        return wanted.join(some.select("_h1", "_h2").distinct(), ["_h1", "_h2"], "left_semi").withColumn("_kind", F.lit(0))

    ranks = _ranks(hashed, texts_of).groupBy(F.col("doc_id").alias("_id"), F.col("_h1").alias("_x"), F.col("_h2").alias("_y")).agg(F.max("_rank").alias("_rank"))
    named = hashed.join(ranks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_x")) & (F.col("_h2") == F.col("_y")), "left")
    return named.select("doc_id", _name("_h1", "_h2", "_rank").alias("fingerprint"))


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``, looked for among every so many of them and then in one stretch."""
    step = max(1, math.isqrt(len(cuts)))
    numbers = lambda some: F.from_json(F.lit(json.dumps(some)), "array<bigint>")  # noqa: E731  one literal in the plan
    whole = F.size(F.filter(numbers(cuts[step - 1 :: step]), lambda c: c < value)) * step
    return whole + F.size(F.filter(F.slice(numbers(cuts), whole + 1, F.lit(step)), lambda c: c < value))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``doc_id, text, next_id, next_text``: each document beside the next by descending id, the first after the last.

    Ids are dealt to ranges of about as many characters; every range also gets a copy of
    the next range's first document, so neighbours are found inside ranges and
    no task sees all rows.  The driver holds one id for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = rows.select(F.col("doc_id").alias("value"), (F.length("text") + 1).cast("long").alias("weight"))
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    n = buckets or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_CHARS)
    cuts = [r["cut"] for r in range_cuts(sizes, max(1, -(-total // n)))][:-1]
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    # bucket 0 has the greatest ids; a bucket holds the ids in (cut before, cut]
    bucket = F.lit(len(cuts)) - _below(cuts, F.col("doc_id"))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(bucket)
    rows = rows.withColumns({"_bucket": bucket, "_order": order})
    # the bucket that ends where this one starts also gets this one's first document; the last gets the very first
    firsts = rows.groupBy("_bucket").agg(F.max("_order").alias("_first"))
    ends_here = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))
    tails = materialize(firsts.select("_first", ends_here.alias("_into")), "bucket-ends")  # a row for each bucket
    if (len(cuts) + 1) * 32 <= BROADCAST_BYTES:
        tails = F.broadcast(tails)
    # of rows that share the first id, the one with the least hash comes first everywhere
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    copies = rows.join(tails, F.col("_order") == F.col("_first")).withColumn("_bucket", F.col("_into")).drop("_first", "_into")
    both = rows.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))
    ring = Window.partitionBy("_bucket").orderBy("_copy", F.col("_order").desc(), "_tie")
    return both.withColumns({"next_id": F.lead("doc_id").over(ring), "next_text": F.lead("text").over(ring)}).where("_copy = 0").select("doc_id", "text", "next_id", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by as many (or all) of the next document's first."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(next_text, F.lit(1), half))


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashes=digests) -> DataFrame:
    """``doc_id, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    One shuffle of the texts, by range of id; what follows has narrow rows, but
    for the texts of buckets with several rows, which are read again.
    """
    pairs = with_next(docs, id_col=id_col, text_col=text_col)
    change = edited(F.col("text"), F.col("next_text"))
    made = pairs.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(change, 256).alias("edited_sha256"), canonical(F.col("text")).alias("_c"), canonical(change).alias("_e"))
    (h1, h2), (e1, e2) = hashes(F.col("_c")), hashes(F.col("_e"))
    narrow = materialize(made.select("doc_id", "next_id", "n_chars", "edited_sha256", h1.alias("_h1"), h2.alias("_h2"), e1.alias("_e1"), e2.alias("_e2")), "fingerprints")
    hashed = narrow.select("doc_id", "next_id", F.lit(0).alias("_kind"), "_h1", "_h2").unionByName(narrow.select("doc_id", "next_id", F.lit(1).alias("_kind"), F.col("_e1").alias("_h1"), F.col("_e2").alias("_h2")))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def texts_of(some: DataFrame) -> DataFrame:
        ids = some.select(F.col("doc_id").alias("_id")).union(some.where("_kind = 1").select("next_id")).where("_id is not null").distinct()
        wanted = materialize(semi(texts, ids, "_id").unionByName(texts.where("_id is null")), "bucket-texts")
        own = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id").withColumnRenamed("_text", "_own")
        whole = own.where("_kind = 0").withColumn("_canonical", canonical(F.col("_own")))
        changed = own.where("_kind = 1").join(wanted, F.col("next_id").eqNullSafe(F.col("_id"))).withColumn("_canonical", canonical(edited(F.col("_own"), F.col("_text"))))
        found = whole.select(*some.columns, "_canonical").unionByName(changed.select(*some.columns, "_canonical"))
        # rows that repeat an id with another text answer for their own bucket only
        h1, h2 = hashes(F.col("_canonical"))
        return found.where((h1 == F.col("_h1")) & (h2 == F.col("_h2")))

    ranks = _ranks(hashed, texts_of).groupBy("doc_id", "_kind", "_h1", "_h2").agg(F.max("_rank").alias("_rank"))
    for kind, (a, b, rank) in enumerate((("_h1", "_h2", "_r"), ("_e1", "_e2", "_er"))):
        r = ranks.where(F.col("_kind") == kind).select(F.col("doc_id").alias("_id"), F.col("_h1").alias("_x"), F.col("_h2").alias("_y"), F.col("_rank").alias(rank))
        narrow = narrow.join(r, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(a) == F.col("_x")) & (F.col(b) == F.col("_y")), "left").drop("_id", "_x", "_y")
    named = narrow.select("doc_id", "next_id", "n_chars", "edited_sha256", _name("_h1", "_h2", "_r").alias("fingerprint"), _name("_e1", "_e2", "_er").alias("edited_fingerprint"))
    follower = named.groupBy(F.col("doc_id").alias("_next")).agg(F.min("fingerprint").alias("_next_fingerprint"))
    same = lambda a, b: F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        named.join(follower, F.col("next_id").eqNullSafe(F.col("_next")), "left")
        .withColumns({"near_edited": same("fingerprint", "edited_fingerprint"), "near_next": same("fingerprint", "_next_fingerprint")})
        .drop("_next", "_next_fingerprint")
    )
