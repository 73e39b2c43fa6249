"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie.  A node's failure link leads to the node for
what is left of its string after greedy longest matches have been cut off its
front, and the node keeps how many pieces those are.  Walking a word then needs
one step for each character and each link, and the piece count comes out by
adding the kept counts: no piece is ever built.

A word is a maximal run without ASCII white space, with ``prefix`` before it;
a word that greedy matching cannot cover is one unknown token.  Null texts
count as empty and have zero words; very long texts are counted whole; null and
repeated ids are carried as they are; an empty table gives an empty result;
extra columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.bpe import Memo
from corvane.llm.common import session


class LongestMatch:
    """Greedy longest-match piece counts over a vocabulary."""

    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        accepts = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                if (to := self.steps[node].get(c)) is None:
                    to = self.steps[node][c] = len(self.steps)
                    self.steps.append({})
                    accepts.append(False)
                node = to
            accepts[node] = node > 0
        self.fail = [-1] * len(self.steps)
        self.popped = [0] * len(self.steps)
        todo = deque([0])
        while todo:  # breadth first: a link's target is shallower, and so is ready
            node = todo.popleft()
            for c, to in self.steps[node].items():
                todo.append(to)
                if accepts[to]:
                    self.fail[to], self.popped[to] = 0, 1
                    continue
                at, n = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.steps[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[to], self.popped[to] = self.steps[at][c], n

    def count(self, word: str) -> int:
        """The number of pieces, or -1 if greedy matching gets stuck."""
        steps, fail, popped = self.steps, self.fail, self.popped
        node = n = 0
        for c in word:
            while (to := steps[node].get(c)) is None:
                if fail[node] < 0:
                    return -1
                n += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return -1
            n += popped[node]
            node = fail[node]
        return n


def piece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=2)
def counter(path: str, prefix: str) -> Memo:
    automaton = LongestMatch(piece_vocabulary(path))
    return Memo(lambda word: automaton.count(prefix + word.decode()), 500_000)


def count_tokens(docs: DataFrame, vocabulary: str, *, prefix: str = "▁", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of each whole text; an unknown word is one token."""
    session(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, prefix).__getitem__
        Memo.only(counter(vocabulary, prefix))
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                counts = list(map(count, text.as_py().split()))
                bad = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
