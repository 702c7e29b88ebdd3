"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Distinct words are sorted into groups of equal length that advance together,
one character at a time.  At every position the hashes of the substrings that
end there (polynomial, from prefix sums) probe the sorted hashes of the
pieces; of the pieces that fit, a vectorised maximum takes the best and stores
a backpointer.

Unigram models maximise the sum of scores.  BPE models are exact, too: in the
encoding of a BPE model every two neighbours are the encoding of their own
concatenation, and of the pieces that end at a position just one forms such a
pair with the piece that the best path had before it.  There a piece that
forms no such pair scores minus infinity; the maximum is over what is left.
Whether two pieces form a pair is found by undoing merges, last first, for all
candidates at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_state

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words longer than this are encoded in a group of their own, which bounds a group's arrays.
_CELLS = 2_000_000
_MEMO_BITS = 21
_FILTER_BITS = 20
_NONE = -(1 << 40)


def _fields(buf: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = buf[at]
            at += 1
            n |= (byte & 0x7F) << shift
            if byte < 0x80:
                return n
            shift += 7

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = buf[at : at + size]
            at += size
        yield key >> 3, kind, value


@dataclass
class Model:
    """Pieces, scores and types of a model file, and its flags."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    bpe: bool
    dummy_prefix: bool = True
    extra_spaces: bool = True  # removed
    escape: bool = True
    byte_fallback: bool = False
    identity: bool = True
    ids: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Model":
        """Reads a model file.  Models that normalise characters are not supported: ValueError."""
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, types = [], [], []
        flags = {"bpe": False, "byte_fallback": False, "dummy_prefix": True, "extra_spaces": True, "escape": True, "identity": True}
        for n, _, v in _fields(raw):
            if n == 1:
                got = {k: x for k, _, x in _fields(v)}
                pieces.append(got.get(1, b"").decode())
                scores.append(np.frombuffer(got[2], "<f4")[0] if 2 in got else 0.0)
                types.append(got.get(3, _NORMAL))
            elif n == 2:
                got = {k: x for k, _, x in _fields(v)}
                flags["bpe"] = got.get(3, 1) == 2
                flags["byte_fallback"] = bool(got.get(35, 0))
            elif n == 3:
                got = {k: x for k, _, x in _fields(v)}
                flags |= {"dummy_prefix": bool(got.get(3, 1)), "extra_spaces": bool(got.get(4, 1)), "escape": bool(got.get(5, 1)), "identity": not got.get(2)}
        if not flags["identity"]:
            raise ValueError("a model that normalises characters is not supported")
        return cls(pieces, np.array(scores, float), np.array(types), ids={p: i for i, p in enumerate(pieces)}, **flags)

    @property
    def unknown(self) -> int:
        return int(np.nonzero(self.types == _UNKNOWN)[0][0])


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def _hash(prefix: np.ndarray, powers: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hash of characters a to b of every word, from prefix hashes."""
    h = prefix[:, b] - prefix[:, a] * powers[b - a]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29)) ^ np.uint64(b - a)


class Encoder:
    """Encodes words of a model; ids of words are kept, at most ``cached_words``."""

    def __init__(self, model: Model, cached_words: int = 400_000):
        self.model, self.cached_words, self.cache = model, cached_words, {}
        use = [i for i in range(len(model.pieces)) if model.types[i] in (_NORMAL, _USER) and model.pieces[i]]
        self.longest = max((len(model.pieces[i]) for i in use), default=1)
        keys = np.zeros(len(use), np.uint64)
        by_len: dict[int, list[int]] = {}
        for k, i in enumerate(use):
            by_len.setdefault(len(model.pieces[i]), []).append(k)
        self.powers = self.inverse = np.ones(1, np.uint64)
        for n, rows in by_len.items():
            prefix, powers = self._prefix(_codes([model.pieces[use[k]] for k in rows], n))
            keys[rows] = _hash(prefix, powers, 0, n)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ids = keys[order], np.array(use, np.int64)[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)  # most substrings are no pieces: seen here before the sorted keys are probed
        self.maybe[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.lengths = np.array([len(p) for p in model.pieces], np.int64)
        self.byte_ids = [model.ids.get(f"<0x{b:02X}>", model.unknown) for b in range(256)]
        known = model.scores[use] if use else np.zeros(1)
        self.unknown_score = float(known.min()) - 10.0
        self.word = regex.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+$")
        self.whole = any(SPACE in model.pieces[i].lstrip(SPACE) for i in use)  # pieces that cross words
        if model.bpe:
            self._merges(use)

    def _prefix(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix hashes of every word, modulo 2^64: sums of characters over powers of the base, times the power reached."""
        n = codes.shape[1]
        if len(self.powers) <= n:
            size = max(n + 1, 2 * len(self.powers))
            self.powers, self.inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(size, x))) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        prefix = np.zeros((len(codes), n + 1), np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.inverse[1 : n + 1], axis=1, out=prefix[:, 1:])
        prefix[:, 1:] *= self.powers[1 : n + 1]
        return prefix, self.powers

    # ---- BPE: which two pieces stay neighbours

    def _merges(self, use: list[int]) -> None:
        m = self.model
        n = len(m.pieces)
        # rank of each piece: merges of the highest score come first; characters were there before
        self.rank = np.full(n, -1, np.int64)
        multi = [i for i in use if len(m.pieces[i]) > 1]
        multi.sort(key=lambda i: (-m.scores[i], i))
        self.rank[multi] = np.arange(len(multi))
        # all pairs of pieces (or characters) whose concatenation is a piece
        pairs, whole = [], []
        ids = {m.pieces[i]: i for i in use}
        extra: dict[str, int] = {}  # characters that are no pieces, yet parts of pieces
        def of(s: str) -> int | None:
            if s in ids:
                return ids[s]
            if len(s) == 1:
                return extra.setdefault(s, n + len(extra))
            return None
        for i in multi:
            s = m.pieces[i]
            for k in range(1, len(s)):
                a, b = of(s[:k]), of(s[k:])
                if a is not None and b is not None:
                    pairs.append((a, b))
                    whole.append(i)
        self.extra, self.stride = extra, n + len(extra)
        self.memo = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.rank = np.append(self.rank, np.full(len(extra), -1, np.int64))
        key = np.array([a * self.stride + b for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_id = key[order], np.array(whole, np.int64)[order]
        # the last merge of each piece, by encoding the piece itself
        self.left, self.right = np.full(self.stride, -1, np.int64), np.full(self.stride, -1, np.int64)
        self.reachable = np.ones(self.stride, bool)
        lookup = dict(zip(self.pair_key.tolist(), self.pair_id.tolist(), strict=True))
        for i in multi:
            parts = [of(c) for c in m.pieces[i]]
            while len(parts) > 2:
                best = min(((self.rank[w], k) for k in range(len(parts) - 1) if (w := lookup.get(parts[k] * self.stride + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = best[1]
                parts[k : k + 2] = [lookup[parts[k] * self.stride + parts[k + 1]]]
            if len(parts) == 2 and lookup.get(parts[0] * self.stride + parts[1]) == i:
                self.left[i], self.right[i] = parts
            else:
                self.reachable[i] = False  # no text is ever encoded with it

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or a large number."""
        key = a * self.stride + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.rank[self.pair_id[at]], 1 << 40)

    def pairs_kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`pairs_stay`, remembering pairs in a table of fixed size, where a newer pair replaces an older one."""
        key = a * self.stride + b
        at = ((key.view(np.uint64) * _MIX) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        out = self.memo[at]
        miss = np.nonzero((out >> 1) != key)[0]
        if len(miss):
            new, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            stay = self.pairs_stay(a[miss[one]], b[miss[one]])
            value = (new << 1) | stay
            self.memo[at[miss[one]]] = value
            out[miss] = value[back]
        return (out & 1).astype(bool)

    def pairs_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's and b's concatenation is just (a, b).

        Undo merges, the later one of the two sides first: before each of
        them, the pieces that then met must not have had an earlier merge.
        """
        n = len(a)
        ok = np.ones(n, bool)
        x, y = a.copy(), b.copy()
        live = np.arange(n)
        limit = np.full(n, 1 << 39, np.int64)  # merges of this rank or later came after what is undone
        from_left = np.zeros(n, bool)
        while len(live):
            r = self._merged(x[live], y[live])
            # a merge over the border wins if it is earlier than the merge that took place,
            # and on equal rank if it stands further left
            lost = (r < limit[live]) | ((r == limit[live]) & ~from_left[live])
            ok[live[lost]] = False
            live = live[~lost]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            more = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[more], rx[more], ry[more]
            # the last of the merges that made x and y: the later rank; of equal ranks the right one
            take_left = rx > ry
            limit[live] = np.where(take_left, rx, ry)
            from_left[live] = take_left
            lx = live[take_left]
            x[lx] = self.right[x[lx]]
            ly = live[~take_left]
            y[ly] = self.left[y[ly]]
        return ok

    # ---- Viterbi

    def _probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose key is a piece's, and the pieces."""
        some = np.nonzero(self.maybe[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])[0]
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        hit = self.keys[at] == key[some]
        return some[hit], self.key_ids[at[hit]]

    def _group(self, words: list[str], length: int) -> list[bytes]:
        """Ids of words of one length, as bytes."""
        m, n = self.model, len(words)
        codes = _codes(words, length)
        prefix, powers = self._prefix(codes)
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        piece = np.full((n, length + 1), _NONE, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        every = np.arange(n)
        for end in range(1, length + 1):
            single = np.zeros(n, bool)  # words whose last character is a piece
            for start in range(max(0, end - self.longest), end):
                hit, own = self._probe(_hash(prefix, powers, start, end))
                if start == end - 1:
                    single[hit] = True
                if not len(hit):
                    continue
                if m.bpe:
                    good = self.reachable[own] & np.isfinite(score[hit, start])
                    if start:
                        before = piece[hit, start]
                        both = np.nonzero(good & (before >= 0))[0]
                        good[both] = self.pairs_kept(before[both], own[both])
                    hit, own = hit[good], own[good]
                    value = np.zeros(len(hit))
                else:
                    value = score[hit, start] + m.scores[own]
                better = value > score[hit, end]
                hit, own, value = hit[better], own[better], value[better]
                score[hit, end], piece[hit, end], back[hit, end] = value, own, start
            # a character without a piece: unknown, and in BPE it parts what stands around it
            if m.bpe:
                none = every[~single & ~np.isfinite(score[:, end]) & np.isfinite(score[:, end - 1])]
                value = np.zeros(len(none))
            else:
                value = score[:, end - 1] + self.unknown_score
                none = np.nonzero(~single & (value > score[:, end]))[0]
                value = value[none]
            score[none, end], back[none, end] = value, end - 1
            piece[none, end] = -1 - codes[none, end - 1].astype(np.int64)
        if not np.isfinite(score[:, length]).all():
            raise ValueError(f"no encoding of {words[int(np.argmin(score[:, length]))]!r}")
        at, steps = np.full(n, length), []
        while at.any():  # all words go back together
            steps.append(np.where(at > 0, piece[every, at], _NONE))
            at = np.where(at > 0, back[every, at], 0)
        path = np.stack(steps[::-1], axis=1) if steps else np.zeros((n, 0), np.int64)
        used = path != _NONE
        ends = np.cumsum(used.sum(axis=1)) * 4
        flat = path[used]
        raw = flat.astype("<u4").tobytes()
        out = [raw[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.nonzero(((path < 0) & used).any(axis=1))[0].tolist():
            out[i] = np.array(self._expand(path[i][used[i]].tolist()), "<u4").tobytes()
        return out

    def _expand(self, ids: list[int]) -> list[int]:
        """Unknown characters to bytes, or to one unknown id for each run of them."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.model.byte_fallback:
                out += [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "replace")]
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encodes what the cache lacks, words of one length at a time."""
        by_len: dict[int, list[str]] = {}
        for w in words:
            if w not in self.cache:
                by_len.setdefault(len(w), []).append(w)
        for n, group in by_len.items():
            step = max(1, _CELLS // (n + 1))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self.cache.update(zip(part, self._group(part, n), strict=True))

    def words(self, text: str) -> list[str]:
        """Words of a text; joined, they are the text as the model sees it."""
        m = self.model
        if m.extra_spaces:
            text = regex.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        if m.dummy_prefix and m.escape and not self.whole and SPACE not in text and "  " not in text and text[-1] != " " and text[0] != " ":
            return (SPACE + text.replace(" ", " " + SPACE)).split(" ")  # the same, faster
        if m.dummy_prefix:
            text = " " + text
        if m.escape:
            text = text.replace(" ", SPACE)
        return [text] if self.whole else self.word.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, one bytes object a text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # so many texts that the distinct words stay few
            held, size = [], 0
            while at + len(held) < len(texts) and (not held or size < 6_000_000):
                t = texts[at + len(held)]
                held.append(self.words(t))
                size += len(t)
            if len(self.cache) > self.cached_words:
                self.cache = {}
            self.learn(set().union(*held).difference(self.cache))
            cache = self.cache
            out += [b"".join([cache[w] for w in ws]) for ws in held]
            at += len(held)
        return out


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.parts = []
        for p, t in zip(model.pieces, model.types, strict=True):
            if t == _BYTE:
                self.parts.append(bytes([int(p[3:5], 16)]))
            elif t == _CONTROL:
                self.parts.append(b"")
            elif t == _UNKNOWN:
                self.parts.append(" ⁇ ".encode())
            else:
                self.parts.append((p.replace(SPACE, " ") if model.escape else p).encode())

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD.  ValueError for an id that is no piece."""
        if len(ids) and int(ids.max()) >= len(self.parts):
            raise ValueError("an id is no piece")
        text = b"".join([self.parts[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _encoder(path: str) -> Encoder:
    return worker_state(("sentencepiece", path), lambda: Encoder(Model.load(path)))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of each whole text; a null or empty text has none."""
    names = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoder(path)
        for b in batches:
            got = e.encode_batch(b.pop("_text").tolist())
            for at in range(0, len(b), 500):
                yield b.iloc[at : at + 500].assign(ids=[np.frombuffer(x, "<u4").astype(np.int32) for x in got[at : at + 500]])

    return docs.select(*keep, text_of(F.col("text")).alias("_text")).mapInPandas(run, f"{names}, ids array<int>")


def decode(tokens: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of ``ids``; null ids give a null text."""
    names = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Decoder(Model.load(path))
        for b in batches:
            yield b.assign(text=[None if x is None else d.decode(np.asarray(x)) for x in b.pop("ids")])

    return tokens.select(*keep, "ids").mapInPandas(run, f"{names}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding the ids gives the text back, of every row.

    Ids are decoded from the bytes that were encoded, in the same pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoder(path)
        d = Decoder(e.model)
        for b in batches:
            text = b.pop("text").tolist()
            ids = e.encode_batch(text)
            back = [d.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield b.assign(
                n_tokens=np.array([len(x) // 4 for x in ids], np.int64),
                ids_crc32=np.array([zlib.crc32(x) for x in ids], np.int64),
                decoded_sha1=pd.Series([_sha1(x) for x in back], index=b.index, dtype=object),
                lossless=np.array([x == t for x, t in zip(back, text, strict=True)], bool),
            )

    kinds = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha1 string, lossless boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInPandas(run, kinds)


def _sha1(text: str) -> str:
    import hashlib

    return hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()
