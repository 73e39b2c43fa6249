"""Operators against plain versions, on small tables with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from corvane.llm import bpe, dac, embed, fingerprint, langid, minhash, mix, pii, substring, wordpiece
from corvane.llm.graph import components
from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _key string, size int, block int"


def texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "été", "straße", "naïve", "x.y", "it's", "12", "\U0001f600"]
    base = [rng.choice(words) for _ in range(60)]
    out: list[str | None] = [None, "", " \t\n", "one", "a b c", "  lead and\ttrail \n\n x ", " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(12):  # near copies, some of them only near each other
        copy = list(base)
        for _ in range(1 + k % 4):
            copy[rng.randrange(60)] = f"edit{k}"
        out.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(20))
    for k in range(8):
        out.append(f"{' '.join(rng.choice(words) + str(k) for _ in range(9))} {passage} tail {k}")
    out.append(" ".join(rng.choice(words) for _ in range(20_000)))
    out.append("mail a.b@c.example.org or +1 (555) 010-2030, card 4111 1111 1111 1111, host 10.0.0.1 999.1.1.1 me@x")
    out.append("a" * 5000)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 3, t, "en", f"s{i % 5}" if i % 6 else None, None, "x", "y", 1, 2) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want: pd.DataFrame) -> None:
    key = want.columns[0]
    a = got.select(list(want.columns)).toPandas().sort_values(key).reset_index(drop=True)
    b = want.sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_bpe(table, empty):
    from pyspark.sql import functions as F

    docs, plain = table
    both = bpe.decode(bpe.encode(docs, *VOCABULARY), *VOCABULARY)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, bpe.encode(docs, *VOCABULARY, with_decoded=True).collect()), key=str)
    same(both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), brute.op1(plain))
    row = bpe.encode(docs.where("text = 'a b c'"), *VOCABULARY).select(bpe.unpack("ids").alias("u"), "ids").first()
    assert row["u"] == np.frombuffer(row["ids"], "<u4").tolist()
    assert bpe.encode(empty, *VOCABULARY).count() == 0


def test_bpe_random_strings():
    codec, rng = bpe.codec(*VOCABULARY), random.Random(7)
    frame = pd.DataFrame({"doc_id": range(2000), "text": ["".join(rng.choice("ab th\n\t ,.'é\x1c\x8512\U0001f600") for _ in range(rng.randrange(25))) for _ in range(2000)]})
    want = brute.op1(frame)
    assert list(map(brute.sha, codec.encode(list(frame.text)))) == list(want.ids_sha256)
    assert [brute.sha(codec.encode([t])[0]) for t in frame.text[:200]] == list(want.ids_sha256[:200])


def test_bpe_merges(monkeypatch):
    """Array and single merges agree with the library on pre-tokens that share buckets, and on very long ones."""
    codec, rng = bpe.ByteBPE(*VOCABULARY), random.Random(12)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    words += ["a" * 5000, "ab" * 3000, "the" * 2000, "".join(rng.choice("ab") for _ in range(4000)), ""]
    want = brute.op1(pd.DataFrame({"doc_id": range(len(words)), "text": words}))
    for shared in (2, 24, 1 << 30):
        monkeypatch.setattr(bpe, "SHARED", shared)
        assert list(map(brute.sha, codec.merge([w.encode() for w in words]))) == list(want.ids_sha256)
        assert not any(codec.leaves)


def test_mix(table, empty, spark):
    docs, plain = table
    got = mix.mix(docs).toPandas()
    assert len(got) == len(plain)
    want = brute.targets(plain)
    for source, rows in got.groupby("source", dropna=False):
        size, target = want[None if pd.isna(source) else source]
        assert rows["size"].sum() == size
        assert rows.target.iloc[0] == pytest.approx(target)
    assert (got.taken <= 2 * got["size"]).all()
    again = mix.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got.sort_values("doc_id").reset_index(drop=True), again)
    assert mix.mix(empty).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 4)) as source")
    sums = mix.mix(many).groupBy("source").agg({"taken": "sum", "target": "max"}).toPandas()
    assert (abs(sums["sum(taken)"] / sums["max(target)"] - 1) < 0.01).all()
    sampled = mix.sample(docs, mix.mix(docs))
    assert sampled.columns == docs.columns and sampled.count() == got.repeats.sum()


def test_minhash(table, empty):
    docs, plain = table
    same(minhash.near_duplicates(docs), brute.op3(plain))
    assert minhash.deduplicate(docs).columns == docs.columns
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_null_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = minhash.near_duplicates(docs).toPandas()
    assert len(got) == 3 and got.kept.all()


def test_signature_estimates():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    (ka, ba), (kb, bb) = minhash.signature(minhash._mix(a[:900])), minhash.signature(minhash._mix(a[100:]))
    x, y = np.frombuffer(ba, np.uint8), np.frombuffer(bb, np.uint8)
    equal = ((x & 15) == (y & 15)).sum() + ((x >> 4) == (y >> 4)).sum()
    assert abs((equal / 128 - 1 / 16) / (15 / 16) - 0.8) < 0.15 and len(ka) == len(kb) == 32


def test_minhash_near_threshold_group(spark, monkeypatch):
    """A large group of copies at similarities around the threshold: right links, and no table with a row for each pair."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(1001):
        copy = list(base)
        for _ in range(rng.choice((3, 3, 4, 4, 5))):
            copy[rng.randrange(120)] = f"e{i}x{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    rows.append((5000, " ".join(base)))
    sizes: dict[str, int] = {}
    real = minhash.materialize

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(minhash, "TILE", 640)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got, brute.op3(pd.DataFrame(rows, columns=["doc_id", "text"])))
    n = len(rows)
    assert sizes["shared-bands"] <= 32 * n and sizes["candidates"] <= n and sizes["tile-links"] <= 32 * n
    assert sizes["hopeful"] <= 32 * n * -(-n // minhash.TILE) and sizes["hopeful-sets"] <= n


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_substring(table, empty):
    from pyspark.sql import functions as F

    docs, plain = table
    got = substring.remove_repeats(docs)
    same(got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), brute.op4(plain))
    assert substring.remove_repeats(empty).count() == 0


def test_substring_blocks(spark):
    """Small blocks, and an id that many rows repeat, change nothing."""
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(i, f"{' '.join(rng.choice('abcdefgh') for _ in range(12))} {passage if i % 3 else 'x'} end {i}") for i in range(60)]
    rows += [(30, f"{passage} row {k} {passage}") for k in range(200)] + [(None, f"{passage} none {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", "n_words", "n_removed", "kept")
    small, large = (sorted(map(tuple, substring.remove_repeats(docs, block_chars=n).select(*columns).collect()), key=str) for n in (300, 1 << 30))
    assert small == large
    assert {(d, n) for d, _, n, _ in small if d in (None, 1, 30)} == {(None, 15), (1, 0), (30, 30), (30, 0)}
    plain = pd.DataFrame(rows[:60], columns=["doc_id", "text"])
    got = substring.remove_repeats(spark.createDataFrame(rows[:60], "doc_id long, text string"), block_chars=200)
    same(got.select("doc_id", "n_words", "n_removed"), brute.op4(plain)[["doc_id", "n_words", "n_removed"]])


def test_packed_hashes():
    x = np.unique(np.array([0, 5, 1 << 50, 1 << 63, (1 << 64) - 1], np.uint64))
    assert (substring.unpack(substring.pack(x)) == x).all()


def test_fingerprint(table, empty, spark):
    docs, plain = table
    got = fingerprint.edit_fingerprints(docs)
    same(got, brute.op5(plain))
    for t, rows in got.toPandas().merge(plain[["doc_id", "text"]], on="doc_id").fillna("").groupby("text"):
        assert rows.fingerprint.nunique() == 1
    assert fingerprint.edit_fingerprints(empty).count() == 0
    forms = spark.createDataFrame([(1, "Café  au lait "), (2, "café AU\nlait"), (3, "cafe au lait"), (4, "ﬁn"), (5, "fin"), (6, "Straße ΟΔΟΣ"), (7, "STRASSE οδος")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint(forms).collect()}
    assert f[1] == f[2] != f[3] and f[4] == f[5] and f[6] == f[7]


def test_fingerprint_collisions(table):
    """With a hash that always collides, bytes alone tell texts apart."""
    from pyspark.sql import functions as F

    docs, _ = table
    bad = lambda c: [F.length(c).cast("long") % 2, F.lit(0).cast("long")]
    named = fingerprint.fingerprint(docs, hashes=bad).toPandas()
    good = fingerprint.fingerprint(docs).toPandas()
    both = named.merge(good, on="doc_id")
    assert both.groupby("fingerprint_x").fingerprint_y.nunique().max() == 1 and both.groupby("fingerprint_y").fingerprint_x.nunique().max() == 1


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows: list = [[i, (centres[i % 6] + rng.normal(size=16) * 0.25).tolist(), 0] for i in range(150)]
    rows += [[200 + i, rows[0][1], 0] for i in range(5)]
    rows += [[300, None, 0], [301, [0.0] * 16, 0], [302, [float("nan")] * 16, 0], [303, [None] * 16, 0], [304, [], 0], [305, [1.0, 2.0], 0], [306, [2.0, 4.0], 0], [307, [1e300, 2e300], 0]]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = brute.op6(frame[frame.vec_id != 307])
    same(got.where("vec_id not in (305, 306, 307)"), want[~want.vec_id.isin([305, 306])])
    assert got.where("vec_id = 307").first()["component_id"] == 305
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_groups(spark, monkeypatch):
    """Small groups, and coordinates that many vectors share."""
    monkeypatch.setattr(embed, "GROUP", 24)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(0, 3, 6)], 0) for i in range(240)] + [(500 + i, [1.0, 0.0, 0.0, 0.0, float(i), 0.0], 0) for i in range(60)]
    rows = [r for r in rows if any(r[1])]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    same(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.95), brute.op6(frame, 0.95))


def test_language(spark, empty):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    extra = spark.createDataFrame([(-1, None), (-2, "12 34 ..."), (-3, "")], "doc_id long, text string")
    got = langid.predict(docs.select("doc_id", "text").unionByName(extra), model)
    assert {r["lang_pred"] for r in got.where("doc_id < 0").collect()} == {langid.UNKNOWN}
    judged = got.join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.9
    assert got.where("score not between 0 and 1").count() == 0
    assert langid.keep_known(docs, model).columns == docs.columns
    assert langid.predict(docs.select("doc_id", "text").limit(3), langid.fit(empty)).select("lang_pred").distinct().first()[0] == langid.UNKNOWN


def test_token_file(table, empty, spark, tmp_path):
    docs, plain = table
    path, vocabulary = f"{tmp_path}/tokens", public_tokenizers.path("word_bpe_49k.json")
    dac.write(docs, path, vocabulary, segment_ids=500)
    same(dac.checksums(dac.read(spark, path)), brute.op8(plain))
    ids = {}
    for r in dac.read(spark, path).collect():
        ids.update(enumerate(np.frombuffer(r["ids"], "<u4").tolist(), r["start"]))
    asked = spark.createDataFrame([(p,) for p in (0, 1, 499, 500, len(ids) - 1, len(ids) + 5)], "position long")
    assert {r["position"]: r["id"] for r in dac.lookup(spark, path, asked).collect()} == {p: ids[p] for p in (0, 1, 499, 500, len(ids) - 1)}
    dac.write(empty, f"{tmp_path}/none", vocabulary)
    assert dac.read(spark, f"{tmp_path}/none").count() == 0


def test_token_file_ids(spark, tmp_path):
    """Null, repeated and extreme ids come back as they were, null first."""
    ids = [None, -(1 << 63), (1 << 63) - 1, 7, 7, None, 0]
    docs = spark.createDataFrame([(i, f"text {k}", k) for k, i in enumerate(ids)], "doc_id long, text string, part int")
    dac.write(docs, f"{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"), segment_ids=4)
    back = dac.read(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, None, -(1 << 63), 0, 7, 7, (1 << 63) - 1]
    assert [r["start"] for r in back] == [sum(r["n_tokens"] for r in back[:k]) for k in range(len(back))]


def test_word_encoder_random_strings():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    whole, encoder = Tokenizer.from_file(path), dac.encoder(path)
    alphabet = ["a", "B", "th", "'s", "'", "é", "e\u0301", "İ", "K", "1", "22", ".", "##", " ", "\n", "\xa0", "\x1c", "\x85", "ß", "ÀÉ", "µ²½", "\xad", "©»", "Σ", "日本", "\U0001f600"]
    for more in ([], ["<|endoftext|>", "<|StartOfText|>"]):
        texts = ["".join(rng.choice(alphabet + more) for _ in range(rng.randrange(20))) for _ in range(3000)]
        for size in (1, 500):
            for at in range(0, len(texts), size):
                for text, ids in zip(texts[at : at + size], encoder.encode(pa.array(texts[at : at + size], pa.string())), strict=True):
                    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_direct_codes():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 1 << 17, 3000), rng.integers(0, 200, 1500), np.array([70000]), np.arange(1024)):
        codes = dac.DirectCodes(dac.DirectCodes.build(ids.astype(np.uint32)))
        assert codes.all().tolist() == ids.tolist() == [codes[i] for i in range(len(ids))]


def test_token_counts(table, empty):
    docs, plain = table
    path = public_tokenizers.path("piece_bpe_32k.model")
    same(wordpiece.count_tokens(docs, path), brute.op9(plain, wordpiece.piece_vocabulary(path)))
    assert wordpiece.count_tokens(empty, path).count() == 0


def test_longest_match_random():
    rng = random.Random(9)
    for _ in range(200):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(12)}
        automaton = wordpiece.LongestMatch(vocabulary)
        for _ in range(50):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == brute.greedy(word, vocabulary, 5)


def test_pii(table, empty, spark):
    from pyspark.sql import functions as F

    docs, plain = table
    found = pii.find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    same(found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS[:4]], F.sha2(pii.spans_text("base").cast("binary"), 256).alias("base_sha256")), brute.op10(plain))
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert "[EMAIL]" in clean.where("text like 'mail%'").first()["text"]
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_pii_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789 -.+@a()") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute.pii_spans(text), text


def test_disclosing_terms(spark):
    rows = [(i, f"please write to secret.agent@mi.example about zanzibar report {i}") for i in range(4)] + [(10 + i, f"please write about report {i}") for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = found.where("doc_id = 0").select(pii.spans_text("spans").alias("s")).first()["s"]
    at = rows[0][1].index("zanzibar")
    assert f"term:{at}:{at + 8}" in spans and "term:0:" not in spans
    assert "[TERM]" in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()["text"]


def test_disclosing_far_terms(spark):
    """Terms count and are marked in whole documents, however far from the entity they stand."""
    far = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"zanzibar {far} secret.agent@mi.example {far} Zanzibar {far} zanzibar") for i in range(3)]
    rows += [(3, f"Secret.Agent@mi.example {far}"), (3, f"{far} zanzibar"), (None, f"zanzibar secret.agent@mi.example {far}"), (None, f"zanzibar {far}")]
    rows += [(10 + i, f"{far} about report {i} host 10.0.0.{i % 9} {'kivu' if i % 9 == 4 else 'lake'} {far}") for i in range(90)] + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs).select("doc_id", pii.spans_text("spans").alias("s")).collect()
    want = brute.op10_all(pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sum(s.count("term") for d, s in want if d in (0, 1, 2)) == 9 and any("term" in s for d, s in want if d == 14)
    assert [s.count("term") for d, s in want if d == 3] == [0, 1] and sorted(s.count("term") for d, s in want if d is None) == [0, 1]
    clean = pii.sanitise(docs).where("doc_id in (0, 1, 2)").collect()
    assert len(clean) == 3 and all("zanzibar" not in r["text"].lower() and r["text"].count("[TERM]") == 3 for r in clean)


def test_disclosing_short_and_numbered_terms(spark):
    """Identifiers with digits and names of one or two characters disclose as words do."""
    rows = [(i, f"李明 and Bo of flat hold AB12x4, write to secret.agent@mi.example on day {i}") for i in range(3)] + [(10 + i, f"and of flat hold write to on day {i}") for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.spans_text("spans").alias("s")).collect()
    want = brute.op10_all(pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(map(tuple, found)) == sorted(want)
    assert [rows[0][1][a:b] for k, a, b in (x.split(":") for x in dict(want)[0].split(",")) if k == "term" for a, b in [(int(a), int(b))]] == ["李明", "Bo", "AB12x4"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    """The queries that SQL can express, against it, on whole tables."""
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = db.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    same(got, want)


def test_pipeline(spark):
    """Two pipelines at once in one driver; of the tables that each writes on its way one is left, and other callers' tables stay."""
    from concurrent.futures import ThreadPoolExecutor
    from pathlib import Path

    import corpus_pipeline
    from corvane.llm.common import materialize, scratch_root

    other = materialize(spark.range(5), "of-another-caller")
    root = Path(scratch_root(spark).removeprefix("file://"))
    before = set(root.iterdir())
    with ThreadPoolExecutor(2) as pool:
        outs = list(pool.map(lambda _: corpus_pipeline.run(spark, "/root/testdata/sf0.001"), range(2)))
    assert len(set(root.iterdir()) - before) == 2
    rows = [sorted(map(str, out.select("doc_id", "n_tokens", "decoded_sha256").collect())) for out in outs]
    assert outs[0].columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and rows[0] == rows[1] and rows[0]
    assert other.count() == 5


def test_range_cuts(spark):
    """Ranges cover all values in order, are about as heavy as asked, and a heavy value is alone in its own."""
    from corvane.llm.common import range_cuts

    rng = np.random.default_rng(8)
    weights = {int(v): int(w) for v, w in zip(rng.choice(100_000, 3000, replace=False), rng.integers(0, 30, 3000), strict=True)}
    weights |= {50_001: 900, 50_002: 5, 50_003: 700, -7: 300}
    rows = [(v, 1) for v, w in weights.items() for _ in range(w)] + [(v, 0) for v in weights] + [(None, 5)]
    found = range_cuts(spark.createDataFrame(rows, "value long, weight long"), 200)
    assert sum(r["weight"] for r in found) == sum(weights.values()) and sum(r["rows"] for r in found) == len(rows) - 1
    cuts = [r["cut"] for r in found]
    assert cuts == sorted(set(cuts)) and cuts[-1] == max(weights)
    own = [r["cut"] for r in found if r["own"]]
    assert own == [-7, 50_001, 50_003] and 50_002 in cuts
    below = 0
    for r in found:
        inside = {v: w for v, w in weights.items() if (not below or v > below) and v <= r["cut"]} if below or r is found[0] else {}
        assert sum(inside.values()) == r["weight"] and (r["own"] or r["weight"] < 2 * 200)
        below = r["cut"]
    assert range_cuts(spark.createDataFrame([], "value long, weight long"), 5) == []


def test_disclosing_many_entities_and_words(spark, monkeypatch):
    """A document of many addresses and words that is copied: rows grow with addresses and words, not with their pairs."""
    words = " ".join(f"w{i}" for i in range(1200))
    addresses = " ".join(f"user{i}@host{i}.example" for i in range(400))
    rows = [(i, f"{addresses} {words}") for i in range(3)] + [(10 + i, f"w{i} lake user{i}@host{i}.example") for i in range(30)] + [(50 + i, "lake w1") for i in range(200)]
    docs, made, real = spark.createDataFrame(rows, "doc_id long, text string"), {}, pii.materialize

    def counting(frame, name):
        out = real(frame, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(pii, "materialize", counting)
    got = sorted(map(tuple, pii.find(docs).select("doc_id", pii.spans_text("spans").alias("s")).collect()))
    assert got == sorted(brute.op10_all(pd.DataFrame(rows, columns=["doc_id", "text"])))
    assert any("term" in s for _, s in got) and max(made.values()) <= 3 * (3 * 400 + 3 * 1200 + 1000)


def test_disclosing_random(spark):
    rng = random.Random(12)
    for threshold in (0.9, 0.6):
        rows = []
        for i in range(80):
            own = rng.sample(range(8), rng.randint(0, 3))
            rows.append((rng.choice([i, i, i, 5, None]), " ".join([f"u{e}@h.example x{e} y{e // 2}" for e in own] + [f"z{rng.randint(0, 9)}" for _ in range(4)])))
        got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).select("doc_id", pii.spans_text("spans").alias("s")).collect()
        want = brute.op10_all(pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}), threshold)
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pipeline_rows(spark):
    """Each stage's rows, but the mixture's choice, against a plain version; of the mixture, each source's rows and targets."""
    import unicodedata

    import corpus_pipeline
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    extra = [(10_000 + i, f"zanzibar {'lake ' * 12}secret.agent@mi.example {' '.join(f'w{i}x{k}' for k in range(40))} zanzibar", "en", "mail", 1) for i in range(4)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = corpus_pipeline.materialize(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "documents")
    for name, stage in corpus_pipeline.STAGES:
        plain, out = docs.toPandas(), corpus_pipeline.materialize(stage(spark, docs, sf), name)
        if name == "language_id":
            want = plain[[any(unicodedata.category(c)[0] == "L" for c in t or "") for t in plain.text]]
            same(out, want)
        elif name == "minhash_dedup":
            want = brute.op3(plain)
            same(out, plain[plain.doc_id.isin(want[want.kept].doc_id)])
        elif name == "pii":
            want = plain.assign(text=[t if t is None else brute.sanitised(t, s) for t, (_, s) in zip(plain.text, brute.op10_all(plain), strict=True)])
            want["n_chars"] = [n if pd.isna(n) else len(t) for n, t in zip(want.n_chars, want.text, strict=True)]
            same(out, want)
            assert want[want.doc_id >= 10_000].text.str.count("TERM").min() >= 2
        elif name == "mix_sources":
            got, targets = mix.mix(docs).toPandas(), brute.targets(plain)
            assert all(t == pytest.approx(targets[None if pd.isna(s) else s][1]) for s, t in zip(got.source, got.target, strict=True))
            want = got.loc[got.index.repeat(got.repeats)][["doc_id"]].merge(plain, on="doc_id")
            a, b = (x[list(plain.columns)].sort_values("doc_id").reset_index(drop=True) for x in (out.toPandas(), want))
            pd.testing.assert_frame_equal(a, b, check_dtype=False)
        else:
            columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            got = out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.op1(plain)[columns].itertuples(index=False)))
        docs = out
