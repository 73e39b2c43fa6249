"""Every registered query as it is registered, against plain versions; and null ids, repeated ids, empty tables and clashing columns."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, dac, embed, fingerprint, langid, minhash, mix, periodic, pii, substring, suffix, wordpiece
from corvane.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return pd.read_parquet(f"{SF}/documents.parquet")


def result(spark, name: str) -> pd.DataFrame:
    return QUERIES[name](spark, SF).toPandas()


def test_op1(spark, plain):
    same(QUERIES["op1_byte_bpe"](spark, SF), brute.op1(plain))


def test_op2(spark, plain):
    got, want = result(spark, "op2_mix_sources"), brute.targets(plain)
    assert sorted(got.doc_id) == sorted(plain.doc_id)
    words = {d: len(brute.WORD.findall(t or "")) for d, t in zip(plain.doc_id, plain.text, strict=True)}
    assert (got["size"] == got.doc_id.map(words)).all() and (got.taken % got["size"].clip(1) == 0).all() and (got.taken <= 2 * got["size"]).all()
    for source, rows in got.groupby("source", dropna=False):
        size, target = want[None if pd.isna(source) else source]
        assert set(rows.source_size) == {size} and rows.target.iloc[0] == pytest.approx(target)
        assert abs(rows.taken.sum() - target) <= max(rows["size"].max(), 1)


def test_op2_choice(spark, plain):
    """The very documents that the seeded choice takes, and how often."""
    docs = plain.astype(object).where(plain.notna(), None)
    keys = {r["doc_id"]: r["k"] for r in spark.createDataFrame([(int(d),) for d in docs.doc_id], "doc_id long").select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("k")).collect()}
    got = result(spark, "op2_mix_sources")
    assert dict(zip(got.doc_id, got.repeats, strict=True)) == brute.choice(docs, keys, brute.targets(docs))


def test_op7_against_a_plain_classifier(spark):
    """Of another kind, learnt from the same folds: naive Bayes on letters' trigrams.  The two agree on nearly all held-out documents."""
    from collections import Counter
    from zlib import crc32

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    grams = lambda t: [w[i : i + 3] for w in re.findall(r"[^\W\d_]+", t.lower()) for w in [f" {w} "] for i in range(len(w) - 2)]
    held = np.array([crc32(str(d).encode()) % 5 == 0 for d in docs.doc_id])
    counts: dict[str, Counter] = {}
    for text, lang in zip(docs.text[~held], docs.lang[~held], strict=True):
        if lang is not None and text:
            counts.setdefault(lang, Counter()).update(grams(text))
    sums = {lang: sum(c.values()) + 1000 for lang, c in counts.items()}
    score = lambda lang, own: sum(n * np.log((counts[lang][g] + 0.1) / sums[lang]) for g, n in own.items())
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").lang_pred
    same_, n = 0, 0
    for doc, text in zip(docs.doc_id[held], docs.text[held], strict=True):
        own = Counter(grams(text or ""))
        if sum(own.values()) >= 40:
            n += 1
            same_ += max(counts, key=lambda lang: score(lang, own)) == got[doc]
    assert n > 100 and same_ >= 0.97 * n


def test_op5(spark, plain):
    got = result(spark, "op5_fingerprint").sort_values("doc_id", ascending=False).reset_index(drop=True)
    want = brute.op5(plain)
    pd.testing.assert_frame_equal(got[["doc_id", "n_chars", "edited_sha256"]], want.reset_index(drop=True), check_dtype=False)
    texts = [t or "" for t in plain.sort_values("doc_id", ascending=False).text]
    follow = texts[1:] + texts[:1]
    changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, follow, strict=True)]

    def canonical(t: str) -> str:
        return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")

    names: dict[str, str] = {}
    for t, name in [*zip(texts, got.fingerprint, strict=True), *zip(changed, got.edited_fingerprint, strict=True)]:
        assert names.setdefault(canonical(t), name) == name
    assert len(set(names.values())) == len(names)
    alike = lambda a, b: [float(canonical(x) == canonical(y)) for x, y in zip(a, b, strict=True)]
    assert got.near_edited.tolist() == alike(texts, changed) and got.near_next.tolist() == alike(texts, follow)


def test_op7(spark, plain):
    """Held-out accuracy, and every prediction against a plain reading of the model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    got = result(spark, "op7_language_id").merge(plain, on="doc_id")
    for r in got.itertuples():
        name, score = brute.language(r.text, model)
        assert (r.lang_pred, pytest.approx(r.score, abs=1e-6)) == (name, score)
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.9


def test_language_families(spark):
    """Two related languages, one of another family and two that no family is known of."""
    words = {"de": "der und nicht ist", "nl": "het een niet zijn", "fr": "les dans pour avec", "xx": "qo zu qi vu", "yy": "qa ze qo wu"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert sorted(map(sorted, model.families)) == [["de", "nl"], ["fr"], ["xx", "yy"]] and sorted(model.pairs) == [("de", "nl"), ("xx", "yy")]
    got = langid.predict(docs.select("doc_id", "text"), model).join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * len(rows)
    few = langid.sample(docs, sample_per_language=5, max_languages=2)
    assert {r["lang"]: r["count"] for r in few.groupBy("lang").count().collect()} == {"de": 5, "fr": 5}


def test_op8(spark, plain):
    same(QUERIES["op8_token_file"](spark, SF), brute.op8(plain))


def test_op9(spark, plain):
    path = public_tokenizers.path("piece_bpe_32k.model")
    same(QUERIES["op9_token_counts"](spark, SF), brute.op9(plain, wordpiece.piece_vocabulary(path)))


def test_op10(spark, plain):
    same(QUERIES["op10_pii"](spark, SF), brute.op10(plain))
    got = QUERIES["op10_pii"](spark, SF).select("doc_id", "spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute.op10_all(plain))


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _file(docs):
    from corvane.llm.common import scratch_path

    path = scratch_path(docs.sparkSession, "tokens")
    dac.write(docs, path, WORD_VOCABULARY)
    return dac.read(docs.sparkSession, path)


OPERATORS = {
    "bpe": lambda d: bpe.encode(d, *VOCABULARY, with_decoded=True),
    "mix": mix.mix,
    "mix_sample": lambda d: mix.sample(d, mix.mix(d)),
    "minhash": minhash.near_duplicates,
    "minhash_kept": minhash.deduplicate,
    "substring": substring.remove_repeats,
    "fingerprint": fingerprint.fingerprint,
    "edits": fingerprint.edit_fingerprints,
    "embeddings": lambda d: embed.near_duplicates(d, id_col="doc_id", vector_col="vector"),
    "language": lambda d: langid.predict(d, langid.fit(d)),
    "language_kept": lambda d: langid.keep_known(d, langid.fit(d)),
    "token_file": _file,
    "token_counts": lambda d: wordpiece.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    "periodic": periodic.periodic_runs,
    "suffix": suffix.remove_repeats,
    "pii": pii.find,
    "pii_texts": pii.sanitise,
}
#: Names that operators use for their own columns.
CLASHES = "_id long, id long, band long, rep long, ids string, _lang string, rank int, part int, block int, group int, _key string, n int, spans string, size int, component long, a long, `order` long, features string"
#: Rows that an operator returns for the eight below, where not all of them.
FEWER = {"minhash_kept": 7, "language_kept": 6}


def _by_id(pairs) -> list[tuple]:
    return sorted(((-1 if doc is None else doc, *rest) for doc, *rest in pairs), key=str)


def check_values(name: str, found: list[dict], rows: list[tuple]) -> None:
    """What each operator gives for ``rows`` (id, text), whatever the ids: null, repeated or not."""
    texts = [(doc, text or "") for doc, text in rows]
    columns = lambda *names: _by_id(tuple(r[c] for c in names) for r in found)
    if name == "bpe":
        plain = brute.op1(pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]}))
        assert columns("doc_id", "n_tokens") == _by_id((None if pd.isna(d) else int(d), int(n)) for d, n in zip(plain.doc_id, plain.n_tokens, strict=True))
        assert _by_id((r["doc_id"], bytes(r["decoded"])) for r in found) == _by_id((d, t.encode()) for d, t in texts)
    if name == "mix":
        assert columns("doc_id", "size") == _by_id((d, len(brute.WORD.findall(t))) for d, t in texts)
        assert all(r["taken"] == r["repeats"] * r["size"] and 0 <= r["repeats"] <= 2 for r in found)
    if name == "minhash":
        sets = [(d, t.lower().split()) for d, t in texts]
        assert columns("doc_id", "n_shingles") == _by_id((d, len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0) for d, w in sets)
    if name == "substring":
        assert columns("doc_id", "n_words") == _by_id((d, len(t.split())) for d, t in texts)
        assert all(r["n_words"] == r["n_removed"] + len(r["kept"].split()) for r in found)
    if name == "fingerprint":
        of: dict = {}
        for r in found:
            of.setdefault(r["doc_id"], []).append(r["fingerprint"])
        for doc, names in of.items():
            assert len(set(names)) == len({t for d, t in texts if d == doc})
    if name == "edits":
        assert columns("doc_id", "n_chars") == _by_id((d, len(t)) for d, t in texts)
        assert all(r["near_edited"] in (0.0, 1.0) and r["near_next"] in (0.0, 1.0) for r in found)
    if name == "language":
        letter = re.compile(r"[^\W\d_]")
        assert _by_id((r["doc_id"], r["lang_pred"] == "und") for r in found) == _by_id((d, letter.search(t) is None) for d, t in texts)
        assert all(0 <= r["score"] <= 1 for r in found)
    if name == "token_file":
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(WORD_VOCABULARY)
        library.encode_special_tokens = True
        want = [(d, [*library.encode(t, add_special_tokens=False).ids, 1]) for d, t in texts]
        assert _by_id((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == _by_id(want)
        order = sorted(found, key=lambda r: r["start"])
        assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order]])[:-1].tolist()
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
        assert ids == sorted(ids)
    if name == "token_counts":
        plain = brute.op9(pd.DataFrame({"doc_id": [-1 if d is None else d for d, _ in rows], "text": [t for _, t in rows]}), wordpiece.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
        assert _by_id(tuple(r.values()) for r in found) == _by_id(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in plain[list(found[0])].itertuples(index=False))
    if name == "pii":
        assert _by_id((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["base"]]) for r in found) == _by_id((d, brute.pii_spans(t)) for d, t in texts)
    if name == "pii_texts":
        assert _by_id((r["doc_id"], "@" in (r["text"] or "")) for r in found) == _by_id((d, False) for d, t in texts)
    if name == "periodic":
        assert columns("doc_id", "n_words", "collapsed") == _by_id((d, len(t.split()), " ".join(t.split())) for d, t in texts)
    if name == "suffix":
        assert columns("doc_id", "n_bytes") == _by_id((d, len(t.encode())) for d, t in texts)
        assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in found)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_and_repeated_ids(spark, name):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen mail a.b@c.example.org"
    rows = [(None, text, "en", "s", [1.0, 2.0]), (None, None, None, None, None), (3, text, "en", "s", [1.0, 2.0]), (3, text, "en", "s", [1.0, 2.0])]
    rows += [(5, f"{text} more", "de", None, [2.0, 4.0]), (6, "", "en", "t", []), (7, "ein zwei", "de", "t", [0.0, 0.0]), (8, "x" * 3000, "de", "t", [-1.0, 3.0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, vector array<double>")
    for column in CLASHES.split(", "):
        title, kind = column.rsplit(" ", 1)
        docs = docs.withColumn(title.strip("`"), F.lit(1).cast(kind))
    out = OPERATORS[name](docs).collect()
    if name == "mix_sample":
        assert 0 < len(out) <= 16
    else:
        assert len(out) == FEWER.get(name, 8)
    found = [r.asDict() for r in out]
    check_values(name, found, [(r[0], r[1]) for r in rows])
    if name == "minhash":
        assert [r["component_id"] for r in found if r["doc_id"] in (3, 5)] == [3, 3, 3] and all(r["kept"] for r in found if r["doc_id"] is None)
    if name == "substring":
        assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found if r["n_removed"]) == [(0, 16), (5, 16)]
    if name == "embeddings":
        assert [r["n_links"] for r in found if r["doc_id" if "doc_id" in r else "vec_id"] == 3] == [2, 2]
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"mix_sample", "minhash_kept", "language_kept", "embeddings"}))
def test_long_texts(spark, name):
    """A text of two megabytes beside short ones, in rows of their own and of one id."""
    rng = np.random.default_rng(11)
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäé"), rng.integers(2, 9))) for _ in range(20_000)]
    words = [stems[i] for i in rng.integers(0, len(stems), 300_000)]
    words[150_000] = "first.last@mail.example.org"
    long = " ".join(words)
    assert len(long.encode()) > 1_800_000
    rows = [(1, long), (2, " ".join(words[:400])), (None, " ".join(words[1000:1400])), (2, "short one")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    found = [r.asDict() for r in OPERATORS[name](docs).collect()]
    check_values(name, found, rows)
    assert len(found) == 4
