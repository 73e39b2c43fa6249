"""Registered queries of the transcript engine, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import responses as R, text as X
from corvane.operators import reports, scoring, store, trends
from corvane.plans import relations as rel
from corvane.sources import files
from corvane.sources.schemas import DIMENSIONS
from corvane.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Phrases that the given texts hold; the default list belongs to spoken calls.
PHRASES = ("of the", "in the", "and the", "the of", "the", *X.DODGE_PHRASES)
PACK_WORDS = 100


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_DIMS = "[" + ", ".join(f"'{d}'" for d in DIMENSIONS) + "]"
_LONG = f"""long AS (
  SELECT company, year, quarter, dimension, score, CAST((year * 10 + CAST(substr(quarter, 2, 1) AS INTEGER)) * 1000 + ascii(company) AS BIGINT) AS transcript_id
  FROM (SELECT c_mktsegment AS company, CAST(year(o_orderdate) AS INTEGER) AS year, 'Q' || quarter(o_orderdate) AS quarter,
               {_DIMS}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS dimension, CAST(1 + count(*) % 10 AS INTEGER) AS score
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""
_WIDE = f"{_LONG}, wide AS (SELECT company, year, quarter, " + ", ".join(f"max(score) FILTER (dimension = '{d}') AS {d}" for d in DIMENSIONS) + " FROM long GROUP BY ALL)"
_STORED = f"{_LONG}, stored AS (SELECT DISTINCT transcript_id AS id, company, quarter, year FROM long)"
_REPLACED = f"{_LONG}, stored AS (SELECT DISTINCT CASE WHEN transcript_id % 7 = 0 THEN -transcript_id ELSE transcript_id END AS id, company, quarter, year FROM long)"
_W = "(PARTITION BY company ORDER BY year, quarter)"
_DELTA = f"{_WIDE}, delta AS (SELECT *, " + ", ".join(f"CAST({d} - lag({d}) OVER {_W} AS DOUBLE) AS {d}_delta" for d in DIMENSIONS) + " FROM wide)"
_TREND = f"{_DELTA}, trend AS (SELECT *, " + ", ".join(f"CASE WHEN {d}_delta <= -1.5 THEN 'IMPROVING' WHEN {d}_delta >= 1.5 THEN 'DETERIORATING' ELSE 'STABLE' END AS {d}_trend" for d in DIMENSIONS) + " FROM delta)"
_STACK = f"""{_WIDE}, stack AS ({" UNION ALL ".join(f"SELECT company, year, quarter, '{d}' AS dimension, {d} AS score FROM wide" for d in DIMENSIONS)}),
moved AS (SELECT *, lag(quarter) OVER w AS prev_quarter, lag(year) OVER w AS prev_year, lag(score) OVER w AS prev_score FROM stack WINDOW w AS (PARTITION BY company, dimension ORDER BY year, quarter)),
worst AS (SELECT * EXCLUDE (n) FROM (SELECT company, year, quarter, score, CAST(score - prev_score AS DOUBLE) AS delta, dimension, prev_quarter, prev_year, prev_score,
          row_number() OVER (PARTITION BY company, dimension ORDER BY score - prev_score DESC, year, quarter) AS n FROM moved WHERE score > prev_score) WHERE n = 1)"""


@query(f"WITH {_WIDE} SELECT * FROM wide")
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.scores_wide(spark, sf_dir)


@query(f"WITH {_DELTA} SELECT * FROM delta")
def quarter_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.chronological(trends.change(rel.scores_wide(spark, sf_dir)))


_MA = ", ".join(f"CASE WHEN count({d}) OVER w = 3 THEN round(avg({d}) OVER w, 6) END AS {d}_ma3" for d in DIMENSIONS)


@query(f"WITH {_WIDE} SELECT company, year, quarter, {_MA} FROM wide WINDOW w AS (PARTITION BY company ORDER BY year, quarter ROWS 2 PRECEDING)")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trends.chronological(trends.moving_average(rel.scores_wide(spark, sf_dir)))
    return found.select("company", "year", "quarter", *[F.round(f"{d}_ma3", 6).alias(f"{d}_ma3") for d in DIMENSIONS])


@query(f"WITH {_TREND} SELECT * FROM trend")
def trend_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.chronological(trends.trend_labels(rel.scores_wide(spark, sf_dir)))


@query(f"WITH {_STACK} SELECT * FROM worst ORDER BY delta DESC, company, dimension")
def biggest_worsening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.biggest_worsening(rel.scores_wide(spark, sf_dir))


@query(f"WITH {_TREND} SELECT company, year, quarter, " + ", ".join(f"{d}_trend" for d in DIMENSIONS) + " FROM trend QUALIFY row_number() OVER (PARTITION BY company ORDER BY year DESC, quarter DESC) = 1")
def latest_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.latest(trends.trend_labels(rel.scores_wide(spark, sf_dir)))


@query(f"WITH {_WIDE} SELECT company, year || ' ' || quarter AS period, {', '.join(DIMENSIONS)} FROM wide WHERE company = 'BUILDING'")
def company_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scores_tab(rel.scores_wide(spark, sf_dir), "building")


@query(f"WITH {_STACK} SELECT company, dimension, year || ' ' || quarter AS period, prev_score || ' -> ' || score || ' (+' || CAST(delta AS INTEGER) || ')' AS note FROM worst WHERE company = 'MACHINERY'")
def worsening_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alerts(rel.scores_wide(spark, sf_dir), "Machinery")


@query(f"WITH {_DELTA} SELECT year || ' ' || quarter AS period, " + ", ".join(f"{d}_delta" for d in DIMENSIONS) + " FROM delta WHERE company = 'FURNITURE'")
def change_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = trends.of_company(trends.change(rel.scores_wide(spark, sf_dir)), "FURNITURE")
    return moved.select(trends.period().alias("period"), *[f"{d}_delta" for d in DIMENSIONS])


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(coalesce(avg({d}), 0), 6) AS average, count({d}) AS n FROM wide" for d in DIMENSIONS))
def dimension_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dimension_averages(rel.scores_wide(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query(f"WITH {_LONG} SELECT count(*) AS n_scores, count(DISTINCT transcript_id) AS n_transcripts FROM long")
def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(rel.scores_wide(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.scores_long(spark, sf_dir).select("transcript_id", "dimension", "score")


@query(f"WITH {_STORED} SELECT s.company, s.quarter, s.year, dimension, score FROM long JOIN stored s ON transcript_id = id WHERE s.company = 'BUILDING' AND s.year = 1996")
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = store.with_scores(_scores(spark, sf_dir), rel.transcripts(spark, sf_dir))
    return store.restrict(joined, "building", None, 1996).select(*store.KEY, "dimension", "score").orderBy("year", "quarter", "dimension")


@query(f"WITH {_STORED} SELECT DISTINCT company, quarter, year FROM stored")
def transcript_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unique_transcripts(rel.transcripts(spark, sf_dir))


@query(f"WITH {_STORED} SELECT DISTINCT year FROM stored WHERE company = 'HOUSEHOLD'")
def company_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.years(rel.transcripts(spark, sf_dir), "household")


@query(f"WITH {_STORED} SELECT DISTINCT company, quarter, year FROM stored WHERE year = 1997 ORDER BY company, year, quarter LIMIT 1")
def sample_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sample_transcript(rel.transcripts(spark, sf_dir), year=1997)


_DONE = "done AS (SELECT s.company, s.quarter, s.year, count(DISTINCT dimension) AS n_dimensions FROM long JOIN stored s ON transcript_id = id WHERE transcript_id % 2 = 0 OR dimension <> 'overpromising' GROUP BY ALL HAVING n_dimensions = 5)"


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    partly = _scores(spark, sf_dir).where("transcript_id % 2 = 0 or dimension <> 'overpromising'")
    return store.fully_scored(partly, rel.transcripts(spark, sf_dir))


@query(f"WITH {_STORED}, {_DONE} SELECT * FROM done")
def fully_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _done(spark, sf_dir)


@query(f"WITH {_STORED}, {_DONE} SELECT DISTINCT company, quarter, year FROM stored s WHERE NOT EXISTS (SELECT 1 FROM done d WHERE (d.company, d.quarter, d.year) = (s.company, s.quarter, s.year))")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.skip_existing(rel.transcripts(spark, sf_dir), _done(spark, sf_dir)).select(*store.KEY)


@query(f"WITH {_STORED} SELECT s.company, s.quarter, s.year, count(*) AS n FROM long JOIN stored s ON transcript_id = id WHERE dimension = 'evasiveness' GROUP BY ALL")
def runs_by_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = store.with_scores(_scores(spark, sf_dir), rel.transcripts(spark, sf_dir))
    return joined.where("dimension = 'evasiveness'").groupBy(*store.KEY).agg(F.count("*").alias("n"))


_WRITES = "writes AS (SELECT transcript_id, dimension, score, 0 AS write_seq FROM long UNION ALL SELECT transcript_id, dimension, CAST(11 - score AS INTEGER), 1 FROM long WHERE transcript_id % 3 = 0)"


@query(f"WITH {_LONG}, {_WRITES} SELECT transcript_id, dimension, score, write_seq FROM writes QUALIFY row_number() OVER (PARTITION BY transcript_id, dimension ORDER BY write_seq DESC) = 1")
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _scores(spark, sf_dir).withColumn("write_seq", F.lit(0))
    second = first.where("transcript_id % 3 = 0").select("transcript_id", "dimension", (11 - F.col("score")).alias("score"), F.lit(1).alias("write_seq"))
    return store.latest_writes(first.unionByName(second), order=("write_seq",))


@query(
    f"""WITH {_REPLACED} SELECT 'orphan scores' AS "check", count(*) AS bad FROM long WHERE transcript_id NOT IN (SELECT id FROM stored)
    UNION ALL SELECT 'duplicate scores', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM long GROUP BY transcript_id, dimension)
    UNION ALL SELECT 'scores out of range', count(*) FILTER (score NOT BETWEEN 1 AND 10) FROM long"""
)
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality(_scores(spark, sf_dir), rel.replaced_transcripts(spark, sf_dir))


@query("SELECT conv_id AS transcript_id, string_agg(text, '|' ORDER BY turn) AS joined, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def assemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = rel.conversations(spark, sf_dir).where("chunk_text is not null")
    rows = turns.select(F.col("chunk_index").alias("id"), F.col("transcript_id").alias("company"), F.lit("").alias("quarter"), F.lit(0).alias("year"), "chunk_index", "chunk_text")
    return store.assemble(rows).select(F.col("company").alias("transcript_id"), F.array_join("chunks", "|").alias("joined"), F.size("chunks").cast("long").alias("n"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents WHERE len(regexp_extract_all(text, '\S+')) >= 50")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at least 50 words."""
    return rel.documents(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("words")).where("words >= 50")


_DIRTY = "'Page 3 of 9' || chr(10) || text || '[PAGE_BREAK]  12 ' || chr(10) || '| 7' || chr(10) || 'CONFIDENTIAL ' || chr(10) || ' This transcript was edited for readability' || chr(10) || 'Kept   line '"
_BOILER = r"(?i)^(?:Page\s+\d+\s+of\s+\d+|\s*Confidential\s*$|\s*Disclaimer.*$|\s*Transcript\s+generated\s+by.*$|\s*www\..*$|\s*\d{1,3}\s*$|\s*\|\s*\d{1,3}\s*$|.*edited for readability.*)"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _cleaned(text: str) -> str:
    return rf"""regexp_replace(array_to_string(list_filter(list_transform(string_split(replace({text}, '[PAGE_BREAK]', chr(10)), chr(10)), lambda x: {_strip("x")}),
    lambda x: x <> '' AND NOT regexp_matches(x, '{_BOILER}')), chr(10)), '[ \t]{{2,}}', ' ', 'g')"""


@query(f"SELECT doc_id, {_cleaned(_DIRTY)} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("Page 3 of 9\n"), F.col("text"), F.lit("[PAGE_BREAK]  12 \n| 7\nCONFIDENTIAL \n This transcript was edited for readability\nKept   line "))
    return rel.documents(spark, sf_dir).select("doc_id", X.clean(dirty).alias("cleaned"))


def _sentences(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


_SENT = _sentences("text")


@query(f"SELECT doc_id, CAST(len({_SENT}) AS INTEGER) AS n_sentences, array_to_string({_SENT}, '|') AS sentences FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.documents(spark, sf_dir).select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query(
    rf"""WITH RECURSIVE units AS (SELECT doc_id, unnest({_SENT}) AS unit, generate_subscripts({_SENT}, 1) AS i FROM documents),
    sized AS (SELECT doc_id, i, unit, len(regexp_extract_all(unit, '\S+')) AS w FROM units),
    run AS (SELECT doc_id, i, unit, w, w AS held, 1 AS chunk FROM sized WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, s.unit, s.w, CASE WHEN r.held + s.w > {PACK_WORDS} THEN s.w ELSE r.held + s.w END, CASE WHEN r.held + s.w > {PACK_WORDS} THEN r.chunk + 1 ELSE r.chunk END
      FROM run r JOIN sized s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
    SELECT doc_id, CAST(chunk - 1 AS INTEGER) AS chunk_index, string_agg(unit, ' ' ORDER BY i) AS chunk_text, CAST(sum(w) AS INTEGER) AS words FROM run GROUP BY doc_id, chunk"""
)
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = X.joined(X.pack(X.sentences(F.col("text")), PACK_WORDS))
    rows = rel.documents(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(packed).alias("chunk_index", "chunk_text"))
    return rows.withColumn("words", X.word_count(F.col("chunk_text")))


_LABEL = r"(?m)^\s*([A-Z][A-Za-z .''-]{2,40}):?\s*$"


def _turns(text: str) -> str:
    """The text's turns as a list; one without a label is the text."""
    marked = rf"string_split(regexp_replace({text}, '{_LABEL}', chr(1) || '\1' || chr(2), 'g'), chr(1))"
    turn = f"{_strip('string_split(x, chr(2))[1]')} || ':' || chr(10) || {_strip('string_split(x, chr(2))[2]')}"
    return f"CASE WHEN len({marked}) > 1 THEN list_transform(({marked})[2:], lambda x: {turn}) ELSE [{text}] END"


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_turns, array_to_string(t, '|') AS turns FROM (SELECT doc_id, {_turns('text')} AS t FROM documents)")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's speaker turns."""
    found = rel.documents(spark, sf_dir).select("doc_id", X.speaker_turns(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n_turns"), F.array_join("t", "|").alias("turns"))


def _packed(rows: str, keys: str, name: str) -> str:
    """Recursive SQL: ``{name}`` numbers the groups (``g``, from 0) of ``rows``' units (``keys``, n from 1, unit, w), packed in order."""
    same = " AND ".join(f"s.{k} = r.{k}" for k in keys.split(", "))
    each = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, n, unit, w, w AS held, 0 AS g FROM {rows} WHERE n = 1
      UNION ALL SELECT {each}, s.n, s.unit, s.w, CASE WHEN r.held + s.w > {PACK_WORDS} THEN s.w ELSE r.held + s.w END, CASE WHEN r.held + s.w > {PACK_WORDS} THEN r.g + 1 ELSE r.g END
      FROM {name} r JOIN {rows} s ON {same} AND s.n = r.n + 1)"""


_WORDS = r"len(regexp_extract_all({}, '\S+'))".format


@query(
    f"""WITH RECURSIVE cleaned AS (SELECT doc_id, {_strip(_cleaned("text"))} AS t FROM documents WHERE text IS NOT NULL),
    parts AS (SELECT doc_id, CASE WHEN {_WORDS("t")} > {2 * PACK_WORDS} THEN {_turns("t")} ELSE [t] END AS u FROM cleaned WHERE t <> ''),
    units AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS i FROM parts),
    split AS (SELECT doc_id, i, unnest({_sentences("unit")}) AS unit, generate_subscripts({_sentences("unit")}, 1) AS n FROM units WHERE {_WORDS("unit")} > {1.5 * PACK_WORDS}),
    sized AS (SELECT *, {_WORDS("unit")} AS w FROM split), {_packed("sized", "doc_id, i", "inner_run")},
    fine AS (SELECT doc_id, i, 0 AS g, unit FROM units WHERE {_WORDS("unit")} <= {1.5 * PACK_WORDS}
      UNION ALL SELECT doc_id, i, g, string_agg(unit, ' ' ORDER BY n) FROM inner_run GROUP BY doc_id, i, g),
    listed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, g) AS n, unit, {_WORDS("unit")} AS w FROM fine), {_packed("listed", "doc_id", "outer_run")}
    SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, string_agg(unit, ' ' ORDER BY n) AS chunk_text, CAST(sum(w) AS INTEGER) AS words FROM outer_run GROUP BY doc_id, g"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the chunker: paragraphs, speaker turns, sentences, packing."""
    rows = rel.documents(spark, sf_dir).select("doc_id", F.posexplode(X.chunks(X.clean(F.col("text")), PACK_WORDS)).alias("chunk_index", "chunk_text"))
    return rows.withColumn("words", X.word_count(F.col("chunk_text")))


_CALLS = """calls AS (SELECT conv_id AS transcript_id, list(CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'We''ll take our FIRST question now. ' || text ELSE text END ORDER BY turn) AS chunks FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"""
_OPEN = r"(?i)(?:first\s+question\s+from\s+the\s+line\s+of|we''?ll\s+take\s+our\s+first\s+question|we\s+have\s+(?:our|a)\s+first\s+question|first\s+question\s+is\s+from\s+the\s+line\s+of)"
_QA = f"{_CALLS}, qa AS (SELECT *, coalesce(list_position(list_transform(chunks, lambda c: regexp_matches(c, '{_OPEN}')), true), 0) - 1 AS qa_start FROM calls)"


@query(f"WITH {_QA} SELECT transcript_id, CAST(qa_start AS INTEGER) AS qa_start, CAST(CASE WHEN qa_start < 0 THEN 0 ELSE len(chunks) - qa_start END AS INTEGER) AS n_qa FROM qa")
def question_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rel.calls(spark, sf_dir)
    return found.select("transcript_id", X.qa_start(F.col("chunks")).alias("qa_start"), F.size(X.qa_chunks(F.col("chunks"))).alias("n_qa"))


_LIST = "(VALUES " + ", ".join("({}, '{}')".format(i + 1, p.replace("'", "''")) for i, p in enumerate(PHRASES)) + ") AS p(pos, phrase)"


@query(f"SELECT pos, phrase, CAST(coalesce(sum(len(regexp_extract_all(text, '(?i)' || phrase))), 0) AS BIGINT) AS hits FROM {_LIST}, documents GROUP BY ALL")
def phrase_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.phrase_counts(rel.documents(spark, sf_dir), PHRASES, "text")


@query(
    f"""WITH parts AS (SELECT doc_id, text, pos, phrase, list_transform(string_split(lower(text), lower(phrase)), lambda x: length(x)) AS lens FROM documents, {_LIST}),
    hits AS (SELECT *, unnest(range(1, len(lens))) AS k FROM parts),
    starts AS (SELECT doc_id, text, pos, phrase, k - 1 AS hit_no, CAST(list_sum(lens[1:k]) + (k - 1) * length(phrase) AS BIGINT) AS s FROM hits)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, phrase, CAST(hit_no AS INTEGER) AS hit_no,
      regexp_replace(replace(substr(text, greatest(s - 40, 0) + 1, least(s + length(phrase) + 40, length(text)) - greatest(s - 40, 0)), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS context FROM starts"""
)
def phrase_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.phrase_hits(rel.documents(spark, sf_dir), PHRASES, "text")


_HITS = f"""WITH {_QA}, joined AS (SELECT transcript_id, CASE WHEN qa_start >= 0 THEN array_to_string(chunks[qa_start + 1:], chr(0)) ELSE '' END AS t FROM qa),
    hits AS (SELECT transcript_id, pos, phrase, len(regexp_extract_all(t, '(?i)' || phrase)) AS n FROM joined, {_LIST})"""


@query(f"{_HITS} SELECT transcript_id, CAST(sum(n) AS INTEGER) AS total_count, coalesce(string_agg(phrase || ' ' || n, ', ' ORDER BY n DESC, pos) FILTER (n > 0), '') AS frequency FROM hits GROUP BY transcript_id")
def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.keyword_result(rel.calls(spark, sf_dir), PHRASES)
    frequency = F.array_join(F.transform("frequency", lambda f: F.concat_ws(" ", f["phrase"], f["n"].cast("string"))), ", ")
    return found.select("transcript_id", "total_count", frequency.alias("frequency"))


@query(f"SELECT pos, phrase, CAST(sum(len(regexp_extract_all(text, '(?i)' || phrase))) AS BIGINT) AS hits FROM {_LIST}, documents GROUP BY ALL HAVING hits > 0 ORDER BY hits DESC, pos LIMIT 3")
def most_frequent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's most frequent phrases, three of those listed."""
    return scoring.top_phrases(rel.documents(spark, sf_dir), PHRASES, "text", n=3)


@query(
    f"""WITH parts AS (SELECT conv_id, turn, text, pos, phrase, list_transform(string_split(lower(text), lower(phrase)), lambda x: length(x)) AS lens FROM conversations, {_LIST} WHERE text IS NOT NULL),
    hits AS (SELECT *, unnest(range(1, len(lens))) AS k FROM parts),
    starts AS (SELECT conv_id, turn, text, pos, phrase, k - 1 AS hit_no, CAST(list_sum(lens[1:k]) + (k - 1) * length(phrase) AS BIGINT) AS s FROM hits
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos, k) <= 5)
    SELECT conv_id AS transcript_id, turn AS chunk_index, CAST(pos AS INTEGER) AS pos, phrase, CAST(hit_no AS INTEGER) AS hit_no,
      regexp_replace(replace(substr(text, greatest(s - 40, 0) + 1, least(s + length(phrase) + 40, length(text)) - greatest(s - 40, 0)), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS context FROM starts"""
)
def phrase_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five excerpts of each call."""
    hits = scoring.phrase_hits(rel.conversations(spark, sf_dir).where("chunk_text is not null").drop("role"), PHRASES)
    return scoring.first_excerpts(hits, ["transcript_id"])


@query(
    rf"""WITH RECURSIVE turns AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
    run AS (SELECT conv_id, i, w, w AS held, 0 AS batch FROM turns WHERE i = 1
      UNION ALL SELECT s.conv_id, s.i, s.w, CASE WHEN r.held + s.w > {PACK_WORDS} THEN s.w ELSE r.held + s.w END, CASE WHEN r.held + s.w > {PACK_WORDS} THEN r.batch + 1 ELSE r.batch END
      FROM run r JOIN turns s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
    SELECT conv_id AS transcript_id, CAST(batch AS INTEGER) AS batch_no, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(w) AS INTEGER) AS words FROM run GROUP BY ALL"""
)
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = rel.conversations(spark, sf_dir).where("chunk_text is not null").groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    batches = X.batches(F.transform("c", lambda c: c["chunk_text"]), PACK_WORDS)
    rows = turns.select("transcript_id", F.posexplode(batches).alias("batch_no", "b"))
    return rows.select("transcript_id", "batch_no", F.size("b").alias("n_chunks"), F.aggregate("b", F.lit(0), lambda a, u: a + X.word_count(u)).alias("words"))


@query(
    """WITH named AS (SELECT lower(c_mktsegment) || '_Q' || quarter(o_orderdate) || '_' || year(o_orderdate) || CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '-x.pdf' END AS name FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT upper(split_part(name, '_', 1)) AS company, split_part(name, '_', 2) AS quarter, CAST(substr(split_part(name, '_', 3), 1, 4) AS INTEGER) AS year, count(*) AS n
    FROM named WHERE NOT contains(name, '-x') GROUP BY ALL"""
)
def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = rel.read(spark, sf_dir, "orders"), rel.read(spark, sf_dir, "customer")
    ending = F.element_at(F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit("-x.pdf")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    name = F.concat(F.lit("/in/"), F.lower("c_mktsegment"), F.lit("_Q"), F.quarter("o_orderdate"), F.lit("_"), F.year("o_orderdate"), ending)
    named = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(name.alias("path"))
    good, _ = files.split_rejects(named)
    return good.select("meta.*").groupBy("company", "quarter", "year").agg(F.count("*").alias("n"))


_RAW = "[" + ", ".join("'" + r.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for r in rel.RESPONSES) + "]"
_PARSED = rf"""raws AS (SELECT CAST(doc_id // 10 AS BIGINT) AS transcript_id, {_DIMS}[CAST(doc_id % 5 + 1 AS INTEGER)] AS dimension, CAST((doc_id % 10) // 5 AS INTEGER) AS batch_no, replace(replace({_RAW}[CAST(doc_id % {len(rel.RESPONSES)} + 1 AS INTEGER)], '@n', CAST(coalesce(length(text), 0) % 12 AS VARCHAR)), '@w', coalesce(regexp_extract(text, '[a-z]+'), '')) AS raw,
    CASE WHEN doc_id % 4 <> 0 THEN doc_id % 100 END AS prompt_tokens, CASE WHEN doc_id % 4 = 1 THEN 7 END AS completion_tokens, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 100 + 7 END AS total_tokens FROM documents),
  cleaned AS (SELECT *, regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>\s*', ''), '^\s+|\s+$', '', 'g') AS c FROM raws),
  js AS (SELECT * EXCLUDE (c), CASE WHEN json_valid(c) THEN c WHEN json_valid(regexp_replace(regexp_replace(c, '^```[^\n]*\n', ''), '```$', '')) THEN regexp_replace(regexp_replace(c, '^```[^\n]*\n', ''), '```$', '') END AS j FROM cleaned),
  parsed AS (SELECT * EXCLUDE (j), CASE WHEN json_type(j, '$.s') = 'BOOLEAN' THEN 1 WHEN json_type(j, '$.s') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(greatest(1, least(10, round_even(CAST(json_extract_string(j, '$.s') AS DOUBLE), 0))) AS INTEGER) END AS score,
    coalesce(CAST(json_extract(j, '$.supporting_quotes') AS VARCHAR[]), [])[1:3] AS quotes FROM js)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raws = rel.responses(spark, sf_dir).withColumn("p", R.parse(F.col("raw"), F.lit("s")))
    return raws.select("*", "p.score", "p.quotes").drop("p")


@query(f"WITH {_PARSED} SELECT transcript_id, dimension, batch_no, score, CASE WHEN score IS NOT NULL THEN array_to_string(quotes, '|') END AS quotes FROM parsed")
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("transcript_id", "dimension", "batch_no", "score", F.array_join("quotes", "|").alias("quotes"))


@query(
    f"""WITH {_PARSED} SELECT transcript_id, dimension, CASE WHEN count(score) > 0 THEN CAST(greatest(1, least(10, round_even(avg(score), 0))) AS INTEGER) END AS score,
    CASE WHEN count(score) > 0 THEN array_to_string(flatten(list(quotes ORDER BY batch_no) FILTER (score IS NOT NULL))[1:3], '|') END AS quotes, string_agg(raw, chr(10) || '---' || chr(10) ORDER BY batch_no) AS raw_response,
    CASE WHEN count(score) = 0 THEN 'No valid scores from any batch' END AS error,
    CAST(CASE WHEN count(coalesce(prompt_tokens, completion_tokens, total_tokens)) > 0 THEN sum(coalesce(total_tokens, 0)) END AS BIGINT) AS total_tokens FROM parsed GROUP BY ALL"""
)
def combine_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = R.combine(_parsed(spark, sf_dir), ["transcript_id", "dimension"])
    quotes = F.when(F.col("score").isNotNull(), F.array_join("supporting_quotes", "|"))
    return done.select("transcript_id", "dimension", "score", quotes.alias("quotes"), "raw_response", "error", "total_tokens")


@query(f"WITH {_PARSED}, t AS (SELECT transcript_id, count(DISTINCT dimension) FILTER (score IS NOT NULL) AS ok FROM parsed GROUP BY ALL) SELECT count(*) FILTER (ok >= 5) AS succeeded, count(*) FILTER (ok < 5) AS failed FROM t")
def success_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tally(R.combine(_parsed(spark, sf_dir), ["transcript_id", "dimension"]))


@query(f"WITH {_PARSED} SELECT transcript_id, dimension, batch_no, CAST(i - 1 AS INTEGER) AS quote_no, quotes[i] AS quote FROM (SELECT *, unnest(range(1, len(quotes) + 1)) AS i FROM parsed WHERE score IS NOT NULL)")
def quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _parsed(spark, sf_dir).where("score is not null").withColumns({"company": F.col("transcript_id"), "year": F.col("batch_no"), "quarter": F.lit(""), "supporting_quotes": F.col("quotes")})
    return reports.quotes(frame).select(F.col("company").alias("transcript_id"), "dimension", F.col("year").alias("batch_no"), "quote_no", "quote")


@query(f"WITH {_PARSED} SELECT count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (score IS NULL) AS failures, CAST(sum(batch_no) AS DOUBLE) AS latency_sum, avg(batch_no) AS latency_avg FROM parsed")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = _parsed(spark, sf_dir).withColumns({"error": F.when(F.col("score").isNull(), F.lit("invalid")), "latency": F.col("batch_no").cast("double")})
    return scoring.run_metrics(called)


@query(f"WITH {_CALLS} SELECT transcript_id, CAST(len(chunks) AS INTEGER) AS n_chunks, 5 AS n_calls FROM calls")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = rel.calls(spark, sf_dir).withColumns({"company": F.lit(""), "quarter": F.lit(""), "year": F.lit(0)})
    return scoring.dry_run(calls).select("transcript_id", "n_chunks", "n_calls")


def offline_scorer(system: str, prompt: str, model: str) -> str:
    """A deterministic stand-in for a model: the prompt's length decides."""
    dimension = next(d for d in DIMENSIONS if f'"{d}_score"' in system)
    return f'{{"{dimension}_score": {1 + len(prompt) % 10}, "supporting_quotes": ["{len(prompt)}"]}}'


@query(
    f"""WITH {_QA}, parts AS (SELECT transcript_id, dimension, CASE WHEN dimension = 'evasiveness' THEN chunks[qa_start + 1:] ELSE chunks END AS c FROM qa, (SELECT unnest({_DIMS}) AS dimension) WHERE dimension <> 'evasiveness' OR qa_start >= 0)
    SELECT transcript_id, dimension, CAST(1 + (length('Score the following call.') + 9 + length(array_to_string(c, chr(10) || chr(10)))) % 10 AS INTEGER) AS score, CAST(NULL AS VARCHAR) AS error FROM parts
    UNION ALL SELECT transcript_id, 'evasiveness', NULL, 'No Q&A section found' FROM qa WHERE qa_start < 0"""
)
def score_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, calls of an offline scorer, parsing and aggregation, end to end."""
    return scoring.score(rel.calls(spark, sf_dir), offline_scorer).select("transcript_id", "dimension", "score", "error")


@query(f"""WITH {_WIDE} SELECT '{{"company":"' || company || '","year":' || year || ',"quarter":"' || quarter || '"' || {" || ".join(f"',\"{d}\":' || coalesce(CAST({d} AS VARCHAR), 'null')" for d in DIMENSIONS)} || '}}' AS record FROM wide""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_records(rel.scores_wide(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream extension's windowed counts, on the table."""
    found = ingest.event_counts(rel.read(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
