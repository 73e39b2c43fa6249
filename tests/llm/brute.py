"""Plain single-machine versions of the queries, to hold the Spark results against."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def op1(docs: pd.DataFrame) -> pd.DataFrame:
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = []
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(text or "")
        rows.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def choice(docs: pd.DataFrame, keys: dict, want: dict) -> dict:
    """How often the mix takes each document: whole epochs, and once more in the order of ``keys``, heavy documents first, up to the rest of the target."""
    taken = {}
    rows = [(s, keys[d], d, len(WORD.findall(t or ""))) for d, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True)]
    for source, (size, target) in want.items():
        own = sorted(r[1:] for r in rows if r[0] == source or (r[0] is None and source is None))
        epochs = target / size if size else 0
        whole, got = int(epochs), 0
        rest = (epochs - whole) * size
        heavy = [r for r in own if r[2] and 32 * r[2] >= size]
        light = [r for r in own if r not in heavy]
        for part, wanted in ((heavy, lambda: rest * sum(r[2] for r in heavy) / size), (light, lambda: rest - got)):
            most, held, found = wanted() if size else 0, 0, 0
            for _, doc, n in part:
                held += n
                more = n > 0 and held - n / 2 < most
                taken[doc] = whole + more if n else 0
                found += n * more
            got += found
    return taken


def targets(docs: pd.DataFrame, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Water-filling by repeated resharing."""
    sizes = defaultdict(int)
    for s, t in zip(docs.source, docs.text, strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return {s: (sizes[s], target[s]) for s in order}


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def op3(docs: pd.DataFrame, percent: int = 75) -> pd.DataFrame:
    sets = {d: shingles(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    by, uf = defaultdict(list), Sets(sets)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    tried = set()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        uf.join(a, b)
    return pd.DataFrame([(d, len(s), uf.find(d), d == uf.find(d)) for d, s in sets.items()], columns=["doc_id", "n_shingles", "component_id", "kept"])


def op4(docs: pd.DataFrame, window: int = 13) -> pd.DataFrame:
    words = {d: WORD.findall(t or "") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    rows = []
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        rows.append((d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone).encode())))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op5(docs: pd.DataFrame) -> pd.DataFrame:
    rows, ordered = [], docs.sort_values("doc_id", ascending=False)
    texts = [t or "" for t in ordered.text]
    for i, (d, t) in enumerate(zip(ordered.doc_id, texts, strict=True)):
        half = len(t) // 2
        rows.append((d, len(t), sha((t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]).encode())))
    return pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256"])


def op6(vectors: pd.DataFrame, threshold: float = 0.9) -> pd.DataFrame:
    ids, rows = list(vectors.vec_id), list(vectors.embedding)
    good = [v is not None and len(v) > 0 and all(x is not None for x in v) and bool(np.isfinite(np.array(v, float)).all()) and bool(np.any(np.array(v, float))) for v in rows]
    uf, links = Sets(ids), dict.fromkeys(ids, 0)
    for i in range(len(ids)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i], float), np.array(rows[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[ids[i]] += 1
                    links[ids[j]] += 1
                    uf.join(ids[i], ids[j])
    return pd.DataFrame([(i, links[i], uf.find(i), i == uf.find(i)) for i in ids], columns=["vec_id", "n_links", "component_id", "kept"])


def op8(docs: pd.DataFrame, end_id: int = 1) -> pd.DataFrame:
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    rows, start = [], 0
    for d, text in sorted(zip(docs.doc_id, docs.text, strict=True)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])


def greedy(word: str, vocabulary: set[str], longest: int) -> int:
    n = at = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in vocabulary:
                n, at = n + 1, end
                break
        else:
            return -1
    return n


def op9(docs: pd.DataFrame, vocabulary: list[str]) -> pd.DataFrame:
    known, longest, memo, rows = set(vocabulary), max(map(len, vocabulary)), {}, []
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        counts = []
        for w in WORD.findall(text or ""):
            if w not in memo:
                memo[w] = greedy("▁" + w, known, longest)
            counts.append(memo[w])
        bad = counts.count(-1)
        rows.append((d, len(counts), sum(counts) + 2 * bad, bad))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_tokens", "n_unknown"])


def luhn(d: str) -> bool:
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0


def pii_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns as written, by the standard library."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(found)]


def op10(docs: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        spans = pii_spans(text or "")
        n = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        rows.append((d, *n, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())))
    return pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])


def op10_all(docs: pd.DataFrame, threshold: float = 0.9, support: int = 3) -> list[tuple]:
    """``(doc_id, spans)`` of each row: base spans, and every word whose mutual information with one of the document's entities reaches the threshold."""
    term = re.compile(r"[^\W_]+")
    rows = [(d, t or "", pii_spans(t or "")) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    names = [{(k, t[a:b].lower() if k == "email" else re.sub("[^0-9]+", "." if k == "ip" else "", t[a:b])) for k, a, b in s} for _, t, s in rows]
    having, holding = {}, {}
    for (d, t, _), own in zip(rows, names, strict=True):
        if not pd.isna(d):
            for w in term.findall(t):
                having.setdefault(w.lower(), set()).add(d)
            for e in own:
                holding.setdefault(e, set()).add(d)
    n, told = len({d for d, _, _ in rows if not pd.isna(d)}), {}
    for e, ds in holding.items():
        for w, ws in having.items():
            both = len(ds & ws)
            if both >= support and (both == n or np.log(both * n / (len(ds) * len(ws))) / np.log(n / both) >= threshold):
                told.setdefault(e, set()).add(w)
    of = {}
    for (d, _, _), own in zip(rows, names, strict=True):
        of.setdefault(d, set()).update(own)
    out = []
    for (d, t, spans), own in zip(rows, names, strict=True):
        marked = set().union(*(told.get(e, set()) for e in (own if pd.isna(d) else of[d])))
        extra = [("term", m.start(), m.end()) for m in term.finditer(t) if m[0].lower() in marked and all(b <= m.start() or m.end() <= a for _, a, b in spans)]
        out.append((None if pd.isna(d) else int(d), ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans + extra, key=lambda s: (s[1], ("email", "ip", "card", "phone", "term").index(s[0]))))))
    return out


def sanitised(text: str, spans: str) -> str:
    """``text`` with a placeholder for each stretch of overlapping ``kind:start:end``, by the first one's kind."""
    owner, cut = [None] * len(text), [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    stretch, last = -1, -1
    for k, a, b in cut:
        stretch += a >= last
        last = b if a >= last else max(last, b)
        for i in range(a, b):
            owner[i] = owner[i] or (stretch, k)
    out, done = [], None
    for c, o in zip(text, owner, strict=True):
        if o is None:
            out.append(c)
        elif o[0] != done:
            out.append(f"[{o[1].upper()}]")
        done = None if o is None else o[0]
    return "".join(out)


def grams(text: str, size: int) -> np.ndarray:
    """Hashed one- to three-character grams of a lower-cased text: square roots of their counts, of unit length."""
    codes, counts, wrap = list(map(ord, text.lower())), np.zeros(size), 0xFFFFFFFF
    for i, c in enumerate(codes):
        one = c * 0x9E3779B1 & wrap
        counts[one >> 20] += 1
        if i + 1 < len(codes):
            two = (one ^ (codes[i + 1] + 0x7F4A7C15)) * 0x85EBCA6B & wrap
            counts[two >> 20] += 1
            if i + 2 < len(codes):
                counts[((two ^ (codes[i + 2] + 0x165667B1)) * 0xC2B2AE35 & wrap) >> 20] += 1
    return np.sqrt(counts) / max(np.sqrt(counts.sum()), 1e-12)


def language(text: str | None, model) -> tuple[str, float]:
    """Family by the greatest margin, then the language that wins most pairs; how clear both were."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    x = np.append(grams(text, model.family_weights.shape[1] - 1), 1.0)
    squash = lambda m: 1 / (1 + np.exp(-2 * m))
    margins = sorted(((float(w @ x), k) for k, w in enumerate(model.family_weights)), reverse=True)
    names = model.families[margins[0][1]]
    sure = squash(margins[0][0] - margins[1][0]) if len(margins) > 1 else 1.0
    if len(names) == 1:
        return names[0], sure
    against = lambda a, b: float(model.pairs[a, b] @ x) if (a, b) in model.pairs else -float(model.pairs[b, a] @ x)
    beaten = {a: [against(a, b) for b in names if b != a] for a in names}
    best = max(names, key=lambda a: (sum(m >= 0 for m in beaten[a]), min(beaten[a]), a))
    return best, sure * squash(2 * min(beaten[best]))
