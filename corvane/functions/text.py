"""Text operators as Column expressions: one projection each, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from corvane.sources.schemas import CHUNK_WORDS, PAGE_BREAK

_SPACE = r"[\s\x1c-\x1f]"
#: The same characters one by one.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Lines that match one of these, from their start, are boilerplate.
BOILERPLATE = (
    r"Page\s+\d+\s+of\s+\d+",
    r"^\s*Confidential\s*$",
    r"^\s*Disclaimer.*$",
    r"^\s*Transcript\s+generated\s+by.*$",
    r"^\s*www\..*$",
    r"^Tata Consultancy Services Earnings Conference Call\s*$",
    r"^[\d:]+\s+(?:hrs\s+)?IST\s*\(?[\d:]+\s*(?:hrs\s+)?US\s+ET\)?\s*\|\s*\d*\s*$",
    r"^External Document\s*©?\s*\d{4}\s+Infosys Limited\s+\d+\s*$",
    r"^\s*\d{1,3}\s*$",
    r"^\s*\|\s*\d{1,3}\s*$",
    r".*edited for readability.*",
    r".*press(?:ing)?\s+star\s+then\s+zero.*touchtone.*",
    r".*forward[- ]looking statement.*must be reviewed in conjunction with the risks.*",
)

# Fixed value: what opens the question-and-answer part, whatever its case.
QA_OPENER = (
    r"(?:first\s+question\s+from\s+the\s+line\s+of|"
    r"we'?ll\s+take\s+our\s+first\s+question|"
    r"we\s+have\s+(?:our|a)\s+first\s+question|"
    r"first\s+question\s+is\s+from\s+the\s+line\s+of)"
)

# Phrases that avoid an answer, in the order that breaks ties.
DODGE_PHRASES = (
    "going forward", "as I mentioned", "as previously stated", "we remain committed", "remain committed to",
    "at this point", "at this stage", "we continue to believe", "continue to believe", "difficult to comment",
    "difficult to say", "too early to say", "too early to comment", "cannot speculate", "not in a position to",
    "not able to comment", "no specific guidance", "we are optimistic", "we remain optimistic", "we do not provide",
    "we don't provide", "wait and watch", "wait and see", "in due course", "in the fullness of time",
    "no further update", "nothing to add", "nothing further to add", "as and when", "we are evaluating",
    "we continue to evaluate", "we will evaluate", "it would be premature", "premature to", "it remains to be seen",
    "time will tell", "let me come back", "I would not like to", "we are not in a position", "we don't want to get into",
    "we cannot quantify", "not really quantified",
)

#: A speaker label: a capital, 2 to 40 further name characters, a colon or not, alone on its line.
SPEAKER_LINE = r"^\s*([A-Z][A-Za-z .'-]{2,40}):?\s*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it: a column is substituted as text otherwise."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(_SPACES))


def word_count(text: Column) -> Column:
    """Maximal runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0))


def clean(text: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    """Page marks become line breaks; blank and boilerplate lines go; runs of blanks become one."""
    boilerplate = r"(?idU)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    lines = F.transform(F.split(F.replace(text, F.lit(PAGE_BREAK), F.lit("\n")), "\n"), strip)
    kept = F.filter(lines, lambda line: (line != "") & ~line.rlike(boilerplate))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]{2,}", " "))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def speaker_turns(text: Column) -> Column:
    """``label:`` and its stripped body for each label; what stands before the first goes; no label: the text."""

    def turn(marked: Column) -> Column:
        return let(F.split(marked, "\u0002"), lambda t: F.concat(strip(t[0]), F.lit(":\n"), strip(t[1])))

    def turns(marked: Column) -> Column:
        return F.when(F.size(marked) <= 1, F.array(text)).otherwise(F.transform(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(1))), turn))

    return let(F.split(F.regexp_replace(text, f"(?dUm){SPEAKER_LINE}", "\u0001$1\u0002"), "\u0001"), turns)


def sentences(text: Column) -> Column:
    """Cut at white space between an end mark and a capital."""
    return F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z])")


def pack(units: Column, target: int) -> Column:
    """Units to groups in order; a group that would pass ``target`` words is closed first; long units stay whole.

    The units' words are counted once; the fold runs over these counts and keeps
    only where groups start.  A new group copies that list, so beside the units'
    number the cost grows with the square of the groups'; texts of very many
    groups are packed across rows by :mod:`corvane.operators.packing`.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("held"), F.lit(0).alias("at"))

    def add(state: Column, words: Column) -> Column:
        close = (state["at"] == 0) | (state["held"] + words > target)
        return F.struct(
            F.when(close, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"),
            F.when(close, words).otherwise(state["held"] + words).alias("held"),
            (state["at"] + 1).alias("at"),
        )

    def cut(units: Column, starts: Column) -> Column:
        ends = F.slice(F.concat(starts, F.array(F.size(units))), F.lit(2), F.greatest(F.size(starts), F.lit(1)))
        return F.zip_with(starts, ends, lambda start, end: F.slice(units, start + 1, end - start))

    def packed(units: Column) -> Column:
        starts = F.aggregate(F.transform(units, word_count), zero, add, lambda state: state["starts"])
        return F.when(F.size(units) > 0, let(starts, lambda s: cut(units, s))).otherwise(F.array().cast("array<array<string>>"))

    return let(units, packed)


def joined(groups: Column, by: str = " ") -> Column:
    return F.transform(groups, lambda g: F.array_join(g, by))


def chunks(text: Column, target: int = CHUNK_WORDS) -> Column:
    """A text's chunks of about ``target`` words.

    Paragraphs are the units; a single paragraph of over twice the target falls
    back to speaker turns, and a unit of over 1.5 times it to packed sentences.
    """

    def units(text: Column, parts: Column) -> Column:
        return F.when((F.size(parts) == 1) & (word_count(parts[0]) > 2 * target), speaker_turns(text)).otherwise(parts)

    def fine(unit: Column) -> Column:
        return F.when(word_count(unit) > 1.5 * target, joined(pack(sentences(unit), target))).otherwise(F.array(unit))

    return let(text, lambda t: joined(pack(F.flatten(F.transform(let(paragraphs(t), lambda parts: units(t, parts)), fine)), target)))


def batches(chunk_list: Column, target: int) -> Column:
    """Chunks to request batches; no chunk gives one empty batch."""
    one = F.array(F.array().cast("array<string>"))
    return let(chunk_list, lambda c: F.when(F.size(c) > 0, pack(c, target)).otherwise(one))


def qa_start(chunk_list: Column) -> Column:
    """The first chunk (from 0) with an opener of the question-and-answer part, or -1."""
    return (F.array_position(F.transform(chunk_list, lambda c: c.rlike(f"(?idU){QA_OPENER}")), True) - 1).cast("int")


def qa_chunks(chunk_list: Column) -> Column:
    """The chunks from the opener on; none without one."""
    at = qa_start(chunk_list)
    return F.when(at >= 0, F.slice(chunk_list, at + 1, F.greatest(F.size(chunk_list), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def strip_thinking(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, rf"(?sU)<think>.*?</think>{_SPACE}*", ""))


def strip_fence(text: Column) -> Column:
    """Without a leading fence line of three backticks and the closing fence."""
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"(?s)\A[^\n]*\n", "")).otherwise(text)
    return F.when(text.startswith("```"), F.when(body.endswith("```"), F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body)).otherwise(text)


def title(name: Column) -> Column:
    """``a_b`` as ``A B``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def prompt(instruction: Column, chunk_list: Column) -> Column:
    return F.concat(instruction, F.lit("\n\nText:\n\n"), F.array_join(chunk_list, "\n\n"))
