"""Phrases in texts: all of them in one scan, whatever their number.

An automaton over the phrases (a trie with suffix links) reads each text once
and reports every phrase that ends at a character.  Of one phrase's hits those
count that do not overlap the one counted before, so the last end of each phrase
is all that is kept; hits of different phrases may overlap.  Time grows with the
text and its hits.  Letters match in either case, by single characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, functions as F

from corvane.sources.schemas import CONTEXT_CHARS


class _Fold(dict):
    """A character's lower case by way of its upper case, where each is one character; the length of a text stays."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        upper = char.upper()
        self[code] = (upper if len(upper) == 1 else char).lower()[0]
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


@lru_cache(maxsize=32)
def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of each folded phrase its places in the list (from 1) and its length."""
    places: dict[str, list[int]] = {}
    for pos, phrase in enumerate(phrases, 1):
        places.setdefault(fold(phrase), []).append(pos)
    made = ahocorasick.Automaton()
    for phrase, own in places.items():
        if phrase:
            made.add_word(phrase, (own, len(phrase)))
    made.make_automaton()
    return made


def scan(text: str, phrases: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
    """``pos, start, end`` of each hit, by where it ends."""
    ends: dict[int, int] = {}
    made = automaton(phrases)
    if not len(made):
        return
    for last, (places, size) in made.iter(fold(text)):
        start = last + 1 - size
        if start >= ends.get(places[0], 0):
            ends[places[0]] = last + 1
            for pos in places:
                yield pos, start, last + 1


_COUNT = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32())]))
#: What :func:`contexts` adds to a row.
HIT = "pos int, hit_no int, context string"
#: Characters of contexts and bytes of their rows that are handed back at once, about.
OUT_BYTES = 4 << 20


def counts(text: Column, phrases: Sequence[str]) -> Column:
    """``pos, n`` of the phrases that occur, by their place in the list (from 1); null for null."""
    own = tuple(phrases)

    def work(t: str) -> list[dict]:
        return [{"pos": pos, "n": n} for pos, n in sorted(Counter(pos for pos, _, _ in scan(t, own)).items())]

    @F.arrow_udf("array<struct<pos:int,n:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([work(t.as_py()) if t.is_valid else None for t in texts], _COUNT)

    return run(text)


def contexts(phrases: Sequence[str], reach: int = CONTEXT_CHARS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` on rows whose text comes last: the other columns and ``pos, hit_no, context`` of each hit, by where it
    ends: what stands ``reach`` characters around it, on one line, stripped.

    Hits are handed back every ``OUT_BYTES``, also within a text, so that a
    task's memory follows neither its rows nor their hits.
    """
    own = tuple(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, texts = batch.columns
            names = [*batch.schema.names[:-1], "pos", "hit_no", "context"]
            each = 32 + sum(c.nbytes for c in rest) // max(1, batch.num_rows)

            def made(rows: list[int], found: list[tuple[int, int, str]]) -> pa.RecordBatch:
                pos, hit_no, context = zip(*found)
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(at) for c in rest), pa.array(pos, pa.int32()), pa.array(hit_no, pa.int32()), pa.array(context, pa.string())], names)

            rows, found, held = [], [], 0
            for row, scalar in enumerate(texts):
                if not scalar.is_valid:
                    continue
                t, seen = scalar.as_py(), Counter()
                for pos, start, end in scan(t, own):
                    context = t[max(start - reach, 0) : end + reach].replace("\n", " ").strip()
                    rows.append(row)
                    found.append((pos, seen[pos], context))
                    seen[pos] += 1
                    held += each + len(context)
                    if held >= OUT_BYTES:
                        yield made(rows, found)
                        rows, found, held = [], [], 0
            if found:
                yield made(rows, found)

    return run
