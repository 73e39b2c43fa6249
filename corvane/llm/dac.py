"""Token-id output as directly addressable codes (DAC).

A segment holds the ids of consecutive documents.  Every id is split into
chunks of eight bits, lowest first.  Level 0 has the first chunk of each id;
a continuation bitmap marks the ids that go on, whose next chunks are level 1
in the same order, and so on.  A rank directory (the number of marked ids
before every 512th) turns a position of one level into a position of the next
by one directory look-up and one popcount, so any id is read without decoding
the ids around it.  Frequent small ids cost one byte and one bit.

File format: Parquet rows ``part, segment, first_doc, n_ids, doc_ids, no_ids,
doc_lens, codes``, whose order by ``part, segment`` is the ascending document
order; ``doc_ids`` (int64) and ``doc_lens`` (uint32) are little-endian arrays,
``no_ids`` is a bitmap of the documents without an id, ``codes`` is the DAC
blob.  Spark reads and writes it, so it lives in any store that Spark reaches.

Null texts count as empty (only the end id is written); rows with a null id
come first; repeated ids keep one entry for each row, next to each other and in no
fixed order; a very long text is encoded whole and closes its segment; extra
columns are ignored;
an empty table gives a readable, empty file.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corvane.llm.bpe import Memo
from corvane.llm.common import BROADCAST_BYTES, gathered, materialize, session, uncollected

SEGMENT_IDS = 1 << 20
DIRECTORY = 512
_SEGMENT = "part int, segment int, first_doc long, n_ids long, doc_ids binary, no_ids binary, doc_lens binary, codes binary"
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class DirectCodes:
    """One DAC blob: ``DirectCodes(DirectCodes.build(ids))[i]`` is ``ids[i]``."""

    def __init__(self, blob: bytes) -> None:
        n_levels, at = blob[0], 1
        self.levels = []
        for _ in range(n_levels):
            n, more = struct.unpack_from("<QB", blob, at)
            at += 9
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = ranks = None
            if more:
                bits = np.frombuffer(blob, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(blob, "<u4", n // DIRECTORY + 1, at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        rest, parts, levels = ids.astype(np.uint64), [], 0
        while True:
            chunks, rest = (rest & 255).astype(np.uint8), rest >> np.uint64(8)
            go_on = rest > 0
            levels += 1
            parts.append(struct.pack("<QB", len(chunks), bool(go_on.any())))
            parts.append(chunks.tobytes())
            if not go_on.any():
                return bytes([levels]) + b"".join(parts)
            bits = np.packbits(go_on, bitorder="little")
            per_byte = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint32)
            per_byte[: len(bits)] = _BITS[bits]
            before = np.concatenate([[0], np.cumsum(per_byte.reshape(-1, 64).sum(1))])
            parts += [bits.tobytes(), before[: len(chunks) // DIRECTORY + 1].astype("<u4").tobytes()]
            rest = rest[go_on]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // DIRECTORY
            inside = bits[block * 64 : i >> 3]
            i = int(ranks[block]) + int(_BITS[inside].sum()) + int(_BITS[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, as unsigned 32-bit integers."""
        out = np.zeros(len(self), np.uint32)
        at = slice(None)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << (8 * level)
            if bits is None:
                break
            marked = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = marked if level == 0 else at[marked]
        return out


# A pattern of pre-tokens, and what it cuts from lines of lower-case Latin-1 words without apostrophes.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"\n|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\na-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_LATIN_WORD = re.compile(r"[!-&(-~¡-¬®-ÿ]+")
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others in order from 256 on.
_SPELL = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)) if b != 10}
#: Bytes of text that are encoded together.
GATHER = 4 << 20


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with what it gave for words and pre-tokens kept for a while.

    The vocabulary must treat ASCII white space as a mere separator, as one
    that drops white space before its merges does: then a text's ids are its
    words' ids in turn.  Where the vocabulary's own rules cut Latin-1 words as
    ``_LATIN`` does, their pre-tokens go to the library's model one by one; any
    other word goes through the library as a whole.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = np.dtype(self.kind)
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        parts = json.loads(self.tokenizer.to_str())
        self.latin = self._cuts_alike(parts["normalizer"], parts["pre_tokenizer"])
        self.model, self.words, self.pieces = self.tokenizer.model, {}, Memo(lambda piece: self._tokenize([piece])[0], limit)

    @staticmethod
    def _cuts_alike(normalizer: dict | None, pre: dict | None) -> bool:
        steps = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
        cut, *rest = (pre or {}).get("pretokenizers", [{}])
        plain = cut.get("pattern") == {"Regex": _CUTS} and cut.get("behavior") == "Removed" and cut.get("invert")
        spelt = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        return bool(steps == ["NFC", "Replace", "Lowercase"] and plain and spelt)

    def _tokenize(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token, spelt as the model has it."""
        other = [p for p in pieces if not p.isascii()]
        respelt = iter("\n".join(other).encode().decode("latin-1").translate(_SPELL).split("\n"))
        spelt = [p if p.isascii() else next(respelt) for p in pieces]
        return [array(self.kind, [t.id for t in self.model.tokenize(p)]).tobytes() for p in spelt]

    def _whole(self, word: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, texts: list[str]) -> list[bytes]:
        """Ids of each word; the simple ones are cut together, a line each."""
        simple = [self.latin and _LATIN_WORD.fullmatch(t) is not None for t in texts]
        lines = "\n".join(compress(texts, simple)).lower()
        if self.special(lines):
            return list(map(self._whole, texts))
        cut = _LATIN.findall(lines + "\n")
        held = dict.fromkeys(cut)
        del held["\n"]
        for piece in held:
            held[piece] = self.pieces.find(piece)
        new = [piece for piece, ids in held.items() if ids is None]
        for piece, ids in zip(new, self._tokenize(new), strict=True):
            held[piece] = ids
            self.pieces.put(piece, ids)
        done, open_ = [], []
        for piece in cut:
            if piece == "\n":
                done.append(b"".join(open_))
                open_ = []
            else:
                open_.append(held[piece])
        rest = iter(done)
        return [next(rest) if ok else self._whole(t) for t, ok in zip(texts, simple, strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (strings, none null).  Words are kept from one call to the next, pre-tokens for longer."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = {w: self.words[w] for w in words if w in self.words}
        new = [w for w in words if w not in found]
        found.update(zip(new, self._learn(new), strict=True))
        self.words = found
        # the ids of all distinct words in a row, and from them those of each word in turn
        own = [found[w] for w in words]
        table = np.frombuffer(b"".join(own), self.width)
        lens = np.fromiter(map(len, own), np.int64, len(own)) // self.width.itemsize
        starts = np.cumsum(lens) - lens
        at = coded.indices.to_numpy()
        n = lens[at]
        ends = np.cumsum(n)
        ids = table[np.repeat(starts[at] - (ends - n), n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return np.split(ids, cuts[1:-1]) if len(texts) else []


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    session(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The ``doc_id`` column of each batch and each row's ids."""
    one = encoder(vocabulary)
    Memo.only(one.pieces)
    end = np.array([] if end_id is None else [end_id], "<u4")
    for batch in gathered(batches, 1, GATHER):
        with uncollected():
            ids = [np.concatenate([x, end]).astype("<u4") for x in one.encode(batch.column(1))]
        yield batch.column(0), ids
    one.words = {}


def encode(docs: DataFrame, vocabulary: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (binary: little-endian unsigned 32-bit), with ``end_id`` after each document's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, vocabulary, end_id):
            yield pa.RecordBatch.from_arrays([doc, pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` as :func:`encode` does and write the ids at ``path``, in ascending ``doc_id`` order.

    Documents are dealt to ranges by quantiles of their ids, so texts are encoded
    once, in front of the only shuffle, which carries two bytes for an id where
    all of a document's fit.  Each range becomes segments of about
    ``segment_ids`` ids; a segment is all that a task holds.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = np.array(sorted(set(ids.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 80 * n)).first()[0] or [])), np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, vocabulary, end_id):
            # range k: ids in (cut before, cut]; null ids come first
            part = np.where(np.asarray(doc.is_null()), -1, np.searchsorted(cuts, np.asarray(doc.fill_null(0)), "left"))
            packed = [b"\4" + x.tobytes() if len(x) and x.max() >= 1 << 16 else b"\2" + x.astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, pa.array(packed, pa.binary())], names=["part", "doc_id", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.only()  # this worker may have encoded before
        at, segment, docs, parts, held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            row = [at, segment, docs[0], held, np.array([d or 0 for d in docs], "<i8").tobytes(), np.packbits([d is None for d in docs], bitorder="little").tobytes(), np.array(list(map(len, parts)), "<u4").tobytes(), DirectCodes.build(np.concatenate(parts))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _SEGMENT.split(", ")])

        for batch in batches:
            for part, doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if docs and (part != at or held >= segment_ids):
                    yield close()
                    segment, docs, parts, held = segment + 1, [], [], 0
                if part != at:
                    at, segment = part, 0
                packed = packed.as_py()
                docs.append(doc)
                parts.append(np.frombuffer(packed, "<u4" if packed[:1] == b"\4" else "<u2", offset=1))
                held += len(parts[-1])
        if docs:
            yield close()

    dealt = _texts(docs, id_col, text_col).mapInArrow(placed, "part int, doc_id long, packed binary").repartition(n, "part").sortWithinPartitions("part", "doc_id")
    dealt.mapInArrow(run, _SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """``part, segment, n_ids, start``: how many ids stand before each segment.

    Sums by part first, so the only unpartitioned window has a row for each part.
    """
    sizes = spark.read.schema(_SEGMENT).parquet(path).select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "segment", "n_ids", (F.col("part_start") + F.col("inside")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit) of each document in the file."""
    session(spark)
    table = spark.read.schema(_SEGMENT).parquet(path).select("part", "segment", "doc_ids", "no_ids", "doc_lens", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.only()
        for batch in batches:
            for row in range(batch.num_rows):
                part, segment, doc_ids, no_ids, doc_lens, codes = (c[row].as_py() for c in batch.columns)
                ids, docs, lens = DirectCodes(codes).all(), np.frombuffer(doc_ids, "<i8"), np.frombuffer(doc_lens, "<u4").astype(np.int64)
                ends, unknown = np.cumsum(lens), np.unpackbits(np.frombuffer(no_ids, np.uint8), count=len(docs), bitorder="little").astype(bool)
                for at in range(0, len(docs), 256):
                    to = slice(at, at + 256)
                    n = len(docs[to])
                    cut = [ids[e - k : e].astype("<u4").tobytes() for e, k in zip(ends[to].tolist(), lens[to].tolist(), strict=True)]
                    known = pa.array(docs[to], pa.int64(), mask=unknown[to])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), known, pa.array(ends[to] - lens[to]), pa.array(lens[to]), pa.array(cut, pa.binary())], names=["part", "segment", "doc_id", "inside", "n_tokens", "ids"])

    docs = table.mapInArrow(run, "part int, segment int, doc_id long, inside long, n_tokens long, ids binary")
    at = materialize(segments(spark, path).select("part", "segment", F.col("start").alias("segment_start")), "segment-starts")
    if at.count() * 32 <= BROADCAST_BYTES:  # then the rows with ids stay where they are
        at = F.broadcast(at)
    return docs.join(at, ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``position, id``: random access by global position (a long column ``position``).

    Positions meet their segments by a range join on the segments' starts, then
    each is read from its segment's codes alone; positions outside are dropped.
    """
    at = segments(spark, path)
    table = spark.read.schema(_SEGMENT).parquet(path).select("part", "segment", "codes")
    asked = positions.select(F.col("position").cast("long")).distinct()
    # a segment answers for its blocks of 2**18 positions: an equi-join instead of a theta join
    block = lambda c: F.floor(c / F.lit(1 << 18))
    covers = at.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.greatest(F.col("n_ids"), F.lit(1)) - 1))))
    hits = asked.withColumn("block", block(F.col("position"))).join(covers, "block").where("position >= start and position < start + n_ids")
    wanted = hits.groupBy("part", "segment").agg(F.collect_list(F.struct("position", (F.col("position") - F.col("start")).alias("inside"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, asks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                direct = DirectCodes(codes.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([a["position"] for a in asks], pa.int64()), pa.array([direct[a["inside"]] for a in asks], pa.int64())], names=["position", "id"])

    return table.join(wanted, ["part", "segment"]).select("codes", "asked").mapInArrow(run, "position long, id long")


def checksums(documents: DataFrame) -> DataFrame:
    """``ids_crc32`` (unsigned) of each row's ``ids`` in place of them."""
    return documents.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
