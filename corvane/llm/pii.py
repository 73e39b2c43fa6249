"""Personal data by patterns, then information-theoretic sanitisation.

Patterns find the base spans: e-mail addresses, IP addresses, card and phone
numbers.  Each value found is a protected entity.  The words of its documents
are terms that may reveal it: over the whole corpus, an entity's documents, a
term's documents and the documents that hold both give the normalised pointwise
mutual information of the two.  At 1 the term occurs exactly where the entity
does, and so names it as surely as the value itself.  Terms that reach the
disclosure threshold in at least ``support`` documents are marked wherever they
stand in the entity's documents.  Sanitising generalises them as it does the
base spans: each span gives way to a placeholder of its kind.

A term is a run of letters and digits, lower-cased; words that touch a base
span count, but are not marked again.  Null texts count as empty and have
no spans; rows that repeat an id count as one document in the statistics and
each get their own spans; a null id takes part in no statistics, but its row is
marked by its own entities; very long texts are read and counted whole; extra
columns are kept by :func:`sanitise`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import BROADCAST_BYTES, anti, fresh, materialize, semi, session

#: Fixed order of the kinds; the method's own kind comes last.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W_]+")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_KEY = "_key struct<none:boolean,at:long>"
_SPANS = "{} array<struct<kind:string,start:long,end:long>>"
#: Sums that a task keeps before it hands them on.
SUMMED = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: its local part is the whole run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind in the order of ``KINDS``."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # a part of over 18 digits is far above 255, but for leading zeros
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups())]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The distinct entities of the spans: hashes of kind and value, with case and separators levelled."""
    found = {}
    for kind, start, end in spans:
        value = text[start:end].lower() if kind == "email" else _NOT_DIGIT.sub("." if kind == "ip" else "", text[start:end])
        found[xxhash.xxh3_64_intdigest(f"{kind}:{value}") - (1 << 63)] = None
    return list(found)


def words(text: str) -> set[str]:
    """The distinct terms of a text."""
    return {w.lower() for w in set(_TERM.findall(text))}


def term_spans(text: str, spans: list[tuple[str, int, int]], terms: set[str]) -> list[tuple[str, int, int]]:
    """Every word of ``text`` that is one of ``terms`` and touches no span."""
    covered: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, k = [], 0
    for w in _TERM.finditer(text):
        while k < len(covered) and covered[k][1] <= w.start():
            k += 1
        if w[0].lower() in terms and (k == len(covered) or covered[k][0] >= w.end()):
            out.append(("term", w.start(), w.end()))
    return out


def _structs(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_key, doc_id, text``: rows share a key if they repeat an id or, without one, the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.xxhash64("text")).alias("at"))
    return rows.select(key.alias("_key"), "doc_id", "text")


def _id_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def find_base(rows: DataFrame) -> DataFrame:
    """``_key, doc_id, spans`` (array of kind, start, end) and ``entities`` of each row."""
    session(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, held = [], []
            for text in batch.column(2).to_pylist():
                own = base_spans(text)
                spans.append(_structs(own))
                held.append(entities(text, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(held, pa.list_(pa.int64()))], names=["_key", "doc_id", "spans", "entities"])

    return rows.mapInArrow(run, f"{_KEY}, doc_id {_id_type(rows)}, {_SPANS.format('spans')}, entities array<long>")


def attach(rows: DataFrame, side: DataFrame, column: str, how: str) -> DataFrame:
    """``rows`` joined by ``_key`` to ``side`` (one row a key, ``column`` an array), which is broadcast only if it is counted small."""
    size = F.aggregate(column, F.lit(0), lambda a, x: a + 16 + F.length(x))
    if (side.agg(F.sum(32 + size)).first()[0] or 0) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return rows.join(side, "_key", how)


def _flushed(sums: dict[str, list[int]]) -> pa.RecordBatch:
    terms, values = list(sums), zip(*sums.values(), strict=True)
    out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(v, pa.int64()) for v in values)], names=["term", "n", "x", "y"])
    sums.clear()
    return out


def term_sums(rows: DataFrame) -> DataFrame:
    """``term, n, x, y``: parts of the numbers of rows that hold a term, and of the exclusive sums of these rows' two marks.

    Each task sums its rows' distinct words before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for t in words(text):
                    own = sums.get(t)
                    if own is None:
                        sums[t] = [1, x, y]
                    else:
                        own[0] += 1
                        own[1] ^= x
                        own[2] ^= y
                if len(sums) > SUMMED:
                    yield _flushed(sums)
        if sums:
            yield _flushed(sums)

    return rows.select("text", "x", "y").mapInArrow(run, "term string, n long, x long, y long")


def word_rows(rows: DataFrame) -> DataFrame:
    """``_key, term``: a row for each distinct word of each document, whichever of the rows that repeat its id hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([list(words(text)) for text in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own], names=["_key", "words"])

    lists = rows.select("_key", "text").mapInArrow(run, f"{_KEY}, words array<string>")
    return lists.select("_key", F.explode("words").alias("term")).distinct()


def _marks() -> list[F.Column]:
    """Two hashes of a document's key.  Their exclusive sums tell sets of documents apart: two sets agree with odds of 2**-128."""
    return [F.xxhash64(F.lit(seed), "_key.none", "_key.at").alias(name) for seed, name in ((1, "x"), (2, "y"))]


def marks(rows: DataFrame, holders: DataFrame, *, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """``_key, terms``: the terms of each document whose normalised mutual information over whole documents with one of its entities reaches ``threshold``.

    ``holders`` are the distinct ``_key, entity``.  Entities of the same documents
    are one class, and so are terms: information depends on the documents alone.
    With a documents that hold the rarer of two and b that hold the other among n,
    it cannot pass log(n / b) / log(n / a), so classes meet only where b is at
    most n ** (1 - threshold) * a ** threshold.  A document adds a row for each of
    its words and each of its entities, and one for each pair of its classes that
    meet, never one for each entity and word.
    """
    known = holders.where("not _key.none")
    classes = known.select("entity", *_marks()).groupBy("entity").agg(F.count("*").alias("en"), F.bit_xor("x").alias("ex"), F.bit_xor("y").alias("ey"))
    classes = materialize(classes.where(F.col("en") >= support), "entities")
    ids = rows.where("not _key.none").groupBy("_key").agg(F.count("*").alias("n"))
    again = materialize(ids.where("n > 1").select("_key"), "repeated-ids")
    total = float(max(ids.count(), 1))
    most = classes.agg(F.max("en")).first()[0] or 0

    def bound(n: F.Column) -> F.Column:
        return F.pow(F.lit(total), F.lit(1 - threshold)) * F.pow(n, F.lit(threshold)) * (1 + 1e-9)

    once = rows.where("not _key.none")
    if again.count():
        twice = word_rows(semi(once, again, "_key")).select("term", F.lit(1).cast("long").alias("n"), *_marks())
        sums = term_sums(anti(once, again, "_key").select("text", *_marks())).unionByName(twice)
    else:
        sums = term_sums(once.select("text", *_marks()))
    sums = sums.groupBy("term").agg(F.sum("n").alias("tn"), F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    terms = materialize(sums.where((F.col("tn") >= support) & (F.col("tn") <= bound(F.lit(float(most))))), "terms")

    own = materialize(holders.join(classes, "entity").select("_key", "en", "ex", "ey").distinct(), "entity-classes")
    held = word_rows(semi(rows, own.select("_key").distinct(), "_key"))
    held = materialize(held.join(terms, "term"), "held-terms")
    pairs = own.join(held.select("_key", "tn", "tx", "ty").distinct(), "_key").where((F.greatest("en", "tn") <= bound(F.least("en", "tn"))) & ~F.col("_key.none"))
    kinds = ["en", "ex", "ey", "tn", "tx", "ty"]
    both = F.col("n") / F.lit(total)
    apart = F.col("en") / F.lit(total) * (F.col("tn") / F.lit(total))
    npmi = F.when(both >= 1, F.lit(1.0)).otherwise(F.log(both / apart) / -F.log(both))
    found = materialize(pairs.groupBy(*kinds).agg(F.count("*").alias("n")).where((F.col("n") >= support) & (npmi >= threshold)).select(*kinds), "disclosing")
    told = own.join(found, ["en", "ex", "ey"]).select("_key", "tn", "tx", "ty").distinct()
    # as many as the document has distinct words, at most
    return told.join(held, ["_key", "tn", "tx", "ty"]).groupBy("_key").agg(F.collect_set("term").alias("terms"))


def find(docs: DataFrame, *, threshold: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` of each row: the base spans, and all spans with the method's own among them."""
    return _find(_keyed(docs, id_col, text_col), threshold, support)


def _find(rows: DataFrame, threshold: float, support: int) -> DataFrame:
    base = materialize(find_base(rows), "base-spans")
    holders = materialize(base.select("_key", F.explode("entities").alias("entity")).distinct(), "holders")
    told = materialize(marks(rows, holders, threshold=threshold, support=support), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, spans = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                first = base_spans(text)
                bases.append(_structs(first))
                spans.append(_structs(sorted(first + term_spans(text, first, set(own)), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "base", "spans"])

    # only rows of documents with terms are read again
    marked = attach(rows, told, "terms", "inner").select("doc_id", "text", "terms").mapInArrow(run, f"doc_id {_id_type(rows)}, {_SPANS.format('base')}, {_SPANS.format('spans')}")
    return anti(base, told.select("_key"), "_key").select("doc_id", F.col("spans").alias("base"), "spans").unionByName(marked)


def spans_text(column: str) -> F.Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replace_spans(text: str, spans: list[dict]) -> str:
    """``text`` with a placeholder for each stretch of overlapping spans, named by the first span's kind."""
    out, done, last = [], 0, -1
    for s in spans:
        if s["start"] >= last:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
            last = s["end"]
        last = max(last, s["end"])
        done = last
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, *, threshold: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with spans generalised in ``text_col``; rows without spans are as they were.

    The spans are joined only to the rows that have some; of rows that repeat an
    id, each takes the spans found for an equal text.
    """
    session(docs.sparkSession)
    # spans are known by two hashes of id and text, so rows that repeat both share them; others agree with odds of 2**-128
    mark, spans = fresh(docs, "_mark"), fresh(docs, "_spans")

    def number(*values: F.Column) -> F.Column:
        return F.struct(*[F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in ((1, "x"), (2, "y"))])

    marked = docs.withColumn(mark, number(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = _keyed(docs, id_col, text_col)
    rows = rows.withColumn("doc_id", number(F.col("doc_id"), F.col("text")))
    found = _find(rows, threshold, support).where("size(spans) > 0")
    found = materialize(found.groupBy(F.col("doc_id").alias(mark)).agg(F.first("spans").alias(spans)), "spans")
    joined = marked.join(found, mark, "left")
    changed, same = joined.where(F.col(spans).isNotNull()), joined.where(F.col(spans).isNull())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replace_spans(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    names = docs.columns
    return changed.select(*names, spans).mapInArrow(run, docs.schema).unionByName(same.select(*names))
