"""Language identification by hierarchical discrimination.

Text is counted as hashed character n-grams (one to three, lower-cased).  A
first set of one-versus-rest linear support vector machines names the family of
the language; inside a family, one linear support vector machine for each pair
of languages votes.  Families are a parameter; languages without one form a
family together.

The machines are fitted in one task on a bounded sample: at most
``sample_per_language`` documents of each language, chosen by hash, of the
``max_languages`` most frequent languages; only their weights reach the driver.
Everything else covers all rows: prediction is one pass without a shuffle.

A null text, an empty one, or one without a letter, is ``und`` with score 0; so
is every text if there was nothing to learn from, as with an empty table, whose
result is empty.  Very long texts are counted whole, in stretches.  Labels that
are null are not learned from; rows that repeat an id and a label are learned
from once; a null id is predicted like any other.  Extra columns are ignored
whatever their names; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm.bpe import Memo
from corvane.llm.common import session

# Families of languages, as ISO 639-1 codes.
_MEMBERS = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk tt",
    "iranian": "fa ps ku tg",
    "indic": "hi ur bn pa mr gu ne or as si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv su mg",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
FAMILIES = {language: family for family, languages in _MEMBERS.items() for language in languages.split()}
#: The family of languages that none is known of.
OTHER = "other"
SIZE = 4096
#: Documents of a language to learn from, at most.
SAMPLE = 600
#: Languages to learn, at most.
LANGUAGES = 32
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_STRETCH = 1 << 16


def features(text: str) -> np.ndarray:
    """Hashed n-gram shares of a whole text, square-rooted, of unit length."""
    counts = np.zeros(SIZE)
    text = text.lower()
    for at in range(0, len(text), _STRETCH):
        # two characters of the stretch before stand in front, so that no n-gram is lost
        code = np.frombuffer(text[max(0, at - 2) : at + _STRETCH].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        skip = min(at, 2)
        one = code * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (code[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (code[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
        for grams in (one[skip:], two[max(0, skip - 1) :], three):
            counts += np.bincount(grams >> np.uint32(20), minlength=SIZE)
    counts = np.sqrt(counts)
    return counts / max(np.sqrt(counts @ counts), 1e-12)


def fit_svm(x: np.ndarray, which: np.ndarray, y: np.ndarray, *, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    """A linear support vector machine (hinge loss, classes weighted alike) by dual coordinate descent.

    ``which`` names the rows of ``x`` (with a last column of ones) to learn from, ``y`` their sides, +-1.
    """
    rng = np.random.default_rng(5)
    cap = np.where(y > 0, penalty * len(y) / (2 * max((y > 0).sum(), 1)), penalty * len(y) / (2 * max((y < 0).sum(), 1)))
    w, alpha = np.zeros(x.shape[1], x.dtype), np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            row, old = x[which[i]], alpha[i]
            # rows are unit vectors and a one: their squares sum to 2
            alpha[i] = min(max(old - (y[i] * float(w @ row) - 1) / 2, 0.0), cap[i])
            if step := alpha[i] - old:
                w += x.dtype.type(step * y[i]) * row
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w.astype(np.float64)


def train(lang: list[str], rows: list[bytes], families: Mapping[str, str]) -> list[tuple[str, str | None, list[str], bytes]]:
    """``(family, null, its languages, weights)`` of each family and ``(a, b, [], weights)`` of each pair in one."""
    order = sorted(range(len(lang)), key=lambda i: (lang[i], rows[i]))
    x = np.ones((len(rows), SIZE + 1), np.float32)
    for at, i in enumerate(order):
        x[at, :SIZE] = np.frombuffer(rows[i], "<f4")
    name = np.array([lang[i] for i in order], object)
    groups: dict[str, list[str]] = {}
    for known in sorted(set(lang)):
        groups.setdefault(families.get(known, OTHER), []).append(known)
    out: list[tuple[str, str | None, list[str], bytes]] = []
    everything = np.arange(len(name))
    for family in sorted(groups):
        weights = fit_svm(x, everything, np.where(np.isin(name, groups[family]), 1.0, -1.0)) if len(groups) > 1 else np.zeros(SIZE + 1)
        out.append((family, None, groups[family], weights.astype("<f8").tobytes()))
        for a, b in combinations(groups[family], 2):
            of = np.flatnonzero(np.isin(name, [a, b]))
            out.append((a, b, [], fit_svm(x, of, np.where(name[of] == a, 1.0, -1.0)).astype("<f8").tobytes()))
    return out


@dataclass(frozen=True)
class Model:
    """Families with their machines, and in each the pairs of languages with theirs."""

    families: list[list[str]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1: how clearly its family and its closest pair won."""
        if text is None or not self.families or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), 1.0)
        margins = self.family_weights @ x
        best = int(np.argmax(margins))
        sure = 1.0 if len(self.families) == 1 else _squash(margins[best] - np.partition(margins, -2)[-2])
        languages = self.families[best]
        if len(languages) == 1:
            return languages[0], sure
        votes, closest = dict.fromkeys(languages, 0.0), dict.fromkeys(languages, np.inf)
        for a, b in combinations(languages, 2):
            margin = float(self.pairs[a, b] @ x)
            votes[a if margin >= 0 else b] += 1
            closest[a], closest[b] = min(closest[a], margin), min(closest[b], -margin)
        name = max(languages, key=lambda k: (votes[k], closest[k], k))
        return name, sure * _squash(2 * closest[name])


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def sample(labelled: DataFrame, *, sample_per_language: int = SAMPLE, max_languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, text`` of the documents to learn from: a bounded number, whatever the table holds.

    Rows of a language with many documents are thinned by hash before they are
    ranked, so a language's task gets a few times its sample, not a share of all rows.
    """
    named = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    narrow = named.where(F.col("text").rlike(r"\p{L}")).select("id", "lang", F.xxhash64("id").alias("order"))
    # one row for each of max_languages languages: small enough to send
    thin = narrow.join(F.broadcast(counts), "lang").where(F.pmod("order", F.lit(1 << 30)) * F.col("n").cast("double") < float(3 * sample_per_language << 30))
    first = Window.partitionBy("lang").orderBy("order", "id")
    # at most max_languages times sample_per_language rows, which is as small
    chosen = thin.distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_per_language).select("id", "lang")
    same = named.alias("x").join(F.broadcast(chosen.alias("y")), F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.lang") == F.col("y.lang")), "left_semi")
    return same.groupBy("id", "lang").agg(F.min("text").alias("text")).where(F.col("text").rlike(r"\p{L}")).select("lang", "text")


def fit(labelled: DataFrame, *, families: Mapping[str, str] = FAMILIES, sample_per_language: int = SAMPLE, max_languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the documents of :func:`sample`; they are counted where they are and meet in one task."""
    session(labelled.sparkSession)
    texts = sample(labelled, sample_per_language=sample_per_language, max_languages=max_languages, id_col=id_col, text_col=text_col, lang_col=lang_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()).astype("<f4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array([0] * len(rows), pa.int32())], names=["lang", "features", "together"])

    def trained(table: pa.Table) -> pa.Table:
        found = train(table.column("lang").to_pylist(), table.column("features").to_pylist(), families)
        kinds = {"a": pa.string(), "b": pa.string(), "languages": pa.list_(pa.string()), "weights": pa.binary()}
        return pa.table({k: pa.array([r[i] for r in found], kind) for i, (k, kind) in enumerate(kinds.items())})

    of = texts.mapInArrow(counted, "lang string, features binary, together int").groupBy("together")
    machines = of.applyInArrow(trained, "a string, b string, languages array<string>, weights binary").collect()
    weights = lambda r: np.frombuffer(r["weights"], "<f8")
    first = sorted((r for r in machines if r["b"] is None), key=lambda r: r["a"])
    return Model([r["languages"] for r in first], np.array([weights(r) for r in first]), {(r["a"], r["b"]): weights(r) for r in machines if r["b"] is not None})


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text."""
    session(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the languages, not on the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, *, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are ``und`` or score below ``least_score``; one pass, no shuffle."""
    session(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.only()
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(at)]
            yield batch.filter(pa.array([name != UNKNOWN and score >= least_score for name, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
