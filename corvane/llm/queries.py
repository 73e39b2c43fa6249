"""The operators' queries: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.text import let
from corvane.llm import bpe, dac, embed, fingerprint, langid, merkle, minhash, mix, periodic, pii, substring, suffix, wordpiece
from corvane.llm.common import WORD, scratch_path


def _tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode by rank-file BPE, decode again, and digest both."""
    import public_tokenizers

    args = _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(_documents(spark, sf_dir, "doc_id", "text"), *args, with_decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 in turn, 150 % of all words, two epochs at most."""
    return mix.mix(_documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("removed").alias("n_intervals"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(_documents(spark, sf_dir, "doc_id", "text")).drop("next_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the four folds that are not held out; predict all."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write the file in document order, and read it back."""
    path = scratch_path(spark, "token-file")
    dac.write(_documents(spark, sf_dir, "doc_id", "text"), path, _tokenizer("word_bpe_49k.json"))
    return dac.checksums(dac.read(spark, path))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_documents(spark, sf_dir, "doc_id", "text"), _tokenizer("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir, "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS[:4]], F.sha2(pii.spans_text("base").cast("binary"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat the tail of a tenth of the documents, chosen by id, then find and collapse all runs."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.transform(words, tail), " ")).otherwise("")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = _documents(spark, sf_dir, "doc_id", "text").withColumn("text", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")))
    found = periodic.periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    done = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed", "n_words")
    length, period = -F.col("b.less"), F.col("b.period")
    milli = F.floor(1000 * length / period)
    return done.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each language; every document proved, a third of them against a text in lower case."""
    fields = ("doc_id", "source", "lang", "n_chars")
    leaf = lambda text: merkle.leaf(*map(F.col, fields), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(lower))
    docs = _documents(spark, sf_dir, *fields, "text").select("doc_id", merkle.tree_name(F.col("lang")).alias("tree"), leaf(F.col("text")).alias("leaf"), tampered.alias("claim"))
    rows = docs.withColumn("claim", F.coalesce("claim", "leaf"))
    return merkle.verify(rows, F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("claim"), keep=("doc_id",))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_mix_sources, op3_minhash_dedup, op4_substring_dedup, op5_fingerprint, op6_embedding_dedup, op7_language_id, op8_token_file, op9_token_counts, op10_pii, op11_periodic_runs, op12_merkle_manifest, op13_suffix_dedup)
}

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _components(node: str) -> str:
    """``comp (node, component)`` from ``links (a, b)``, by plain reachability."""
    return f"""edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS {node}, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.{node}),
    comp AS (SELECT {node}, min(root) AS component FROM reach GROUP BY {node})"""


#: CRC-32 of the decimal ``doc_id``: its bits, least significant first, through the reflected polynomial.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_transform(range(8), lambda k: (ascii(c) >> CAST(k AS INTEGER)) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""


def _fields(text: str) -> str:
    """A leaf's fields: ``-`` for null, else byte count, colon and value."""
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))


#: DuckDB SQL with the same result, where SQL can express it.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_dedup": f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
    starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
    sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM starts),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    {_components("doc_id")}
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN comp ON comp.doc_id = d.doc_id""",
    "op4_substring_dedup": f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
    starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
    win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM starts),
    first_in AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
    repeats AS (SELECT doc_id, i FROM win JOIN first_in USING (s) WHERE d < doc_id),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeats, (SELECT unnest(range(13)) AS k)),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
    marked AS (SELECT x.doc_id, x.i, word, g.i IS NOT NULL AS cut FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i),
    edged AS (SELECT *, cut AND NOT lag(cut, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM marked),
    done AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (cut) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT cut) AS kept, count(*) FILTER (opens) AS n_intervals FROM edged GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_intervals, 0) AS INTEGER) AS n_intervals
    FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id""",
    "op6_embedding_dedup": f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= 0.9 ELSE false END),
    {_components("vec_id")},
    counts AS (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY a)
    SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(component, v.vec_id) AS component_id, coalesce(component, v.vec_id) = v.vec_id AS kept
    FROM v LEFT JOIN counts ON counts.vec_id = v.vec_id LEFT JOIN comp ON comp.vec_id = v.vec_id""",
    "op12_merkle_manifest": f"""
    WITH RECURSIVE src AS (SELECT *, {_CRC} AS crc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents),
    leaves AS (
        SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
            sha256({_fields("text")}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256({_fields("lower_text")}) ELSE sha256({_fields("text")}) END AS claim FROM src),
    nodes AS (
        SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
        UNION ALL
        SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8, n),
    subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
    top AS (
        SELECT 0 AS level, i, n, subroot AS h FROM subroots
        UNION ALL
        SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8, n),
    fold AS (
        SELECT doc_id, tree, 0 AS level, i, n, claim AS cur, '' AS sibs FROM leaves
        UNION ALL
        SELECT f.doc_id, f.tree, f.level + 1, f.i // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN x.i = f.i THEN f.cur ELSE x.h END, '' ORDER BY x.i)),
            f.sibs || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> f.i), '')
        FROM fold f JOIN nodes x ON x.tree = f.tree AND x.level = f.level AND x.i // 8 = f.i // 8 WHERE f.n > 1 GROUP BY f.doc_id, f.tree, f.level, f.i, f.n, f.cur, f.sibs),
    rest AS (
        SELECT f.doc_id, s.subroot, 0 AS level, s.i, s.n, f.cur, f.sibs FROM fold f JOIN subroots s ON s.tree = f.tree WHERE f.n = 1
        UNION ALL
        SELECT f.doc_id, f.subroot, f.level + 1, f.i // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN x.i = f.i THEN f.cur ELSE x.h END, '' ORDER BY x.i)),
            f.sibs || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> f.i), '')
        FROM rest f JOIN top x ON x.level = f.level AND x.i // 8 = f.i // 8 WHERE f.n > 1 GROUP BY f.doc_id, f.subroot, f.level, f.i, f.n, f.cur, f.sibs)
    SELECT r.doc_id, l.leaf, r.subroot, t.h AS root, sha256(r.sibs) AS proof_sha256, r.cur AS folded_root, r.cur = t.h AS verified
    FROM rest r JOIN leaves l ON l.doc_id = r.doc_id JOIN top t ON t.n = 1 WHERE r.n = 1""",
    "op13_suffix_dedup": """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    part AS (SELECT doc_id, c, substr(h, 2 * c + 1, 798) AS p FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 200)) AS c FROM d)),
    win AS (SELECT doc_id, c + j AS i, md5(substr(p, 2 * j + 1, 400)) AS s FROM (SELECT doc_id, c, p, unnest(range(0, len(p) // 2 - 199)) AS j FROM part)),
    again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
    hit AS (SELECT doc_id, i FROM win JOIN again USING (s)),
    edged AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS opens FROM hit),
    runs AS (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edged) GROUP BY doc_id, r),
    gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY b) AS z FROM (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)),
    kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, len(h) // 2) - a)), '' ORDER BY a) AS k FROM d JOIN gaps USING (doc_id) GROUP BY d.doc_id),
    sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM runs GROUP BY doc_id)
    SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id""",
}
