"""Packing documents into fixed-length sequences by linear grouping.

The plan needs the histogram of lengths alone, which has at most one entry per
length however large the corpus.  Large lengths are rounded up within groups
of equal cardinality; for these few sizes, fillings (configurations) are
optimised by column generation; the actual lengths take the places of the
rounded ones; what room is left, best fit fills with sets of small lengths.  All
of this is done on runs of equal bins, never on single documents.  Then every
document finds its place by its rank among the documents of its length.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, release, save, text_of, worker_state

CAPACITY = 2048
END_ID = 0
#: Letters of texts that are worked on at once, and of the longest words that are remembered: memory follows no text's words.
BLOCK = 1_000_000
CACHED_LETTERS = 48
#: Groups from which on lengths are rounded little enough.
FINE = 64


@dataclass(frozen=True)
class PackParams:
    """large: lengths over capacity / large are grouped; groups: numbers of
    sizes to round them to, of which the best is kept.  rows_per_salt: rows of
    one length that are ranked together, about.  cached_words: what a worker
    keeps of the words of up to CACHED_LETTERS letters it met."""

    capacity: int = CAPACITY
    large: int = 6
    groups: tuple[int, ...] = (12, 24, 72)
    rows_per_salt: int = 512
    cached_words: int = 360_000


# Fixed values of the tokenizer file: how words are parted once letters are small, and the mark of a part's last token.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_END = "</w>"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(other)}


class WordTokenizer:
    """Ids of whole texts from kept ids of the words between blanks.

    For byte-level BPE tokenizers that compose characters, fold white space
    and letters and part words by _PARTS.  All but the merges is done here on
    many new words at once; new parts then go through the model.  The words
    and parts used of late are kept, in two generations.  The tokenizer's added
    tokens are taken whole, before all else.
    """

    def __init__(self, path: str, cached_words: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        self.model = Tokenizer(whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(_PARTS + r"|\n").findall
        self.letters = _byte_letters()
        added = whole.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that are not plain strings")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.part = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        vocab = whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_END)]] = True
        self.limit = cached_words // 2
        self.young, self.old = _Known({"": b""}), {}
        self.young_parts, self.old_parts = {}, {}

    def _learn_parts(self, parts: Iterable[str]) -> None:
        if len(self.young_parts) > self.limit:
            self.old_parts, self.young_parts = self.young_parts, {}
        known, new = self.young_parts, []
        for p in parts:
            if p not in known:
                if (ids := self.old_parts.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = ids
        for at in range(0, len(new), 4_000):
            some = new[at : at + 4_000]
            text = " ".join([p.encode().decode("latin-1").translate(self.letters) for p in some])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(some):
                raise ValueError("parts do not end as they should")
            raw = ids.tobytes()
            known.update({p: raw[a:z] for p, a, z in zip(some, [0, *stops[:-1]], stops, strict=True)})

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            parts = self.split("\n".join(some))
            distinct = dict.fromkeys(parts)
            distinct.pop("\n", None)
            self._learn_parts(distinct)
            known = self.young_parts
            out, own = [], []
            for p in parts:
                if p == "\n":
                    out.append(b"".join(own))
                    own = []
                else:
                    own.append(known[p])
            out.append(b"".join(own))
            self.young.update(zip(some, out, strict=True))
            for p in distinct:
                if len(p) > CACHED_LETTERS:
                    del known[p]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, one bytes object a text."""
        parted = {i: self.part(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if not parted:
            return self._encode(texts)
        plain = iter(self._encode([x for i, t in enumerate(texts) for x in (parted[i][::2] if i in parted else [t])]))
        # between two plain pieces stands an added token
        return [b"".join([self.added[x] if k % 2 else next(plain) for k, x in enumerate(parted[i])]) if i in parted else next(plain) for i in range(len(texts))]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        size = np.cumsum([len(t) for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), len(texts)]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if len(self.young) > self.limit:
                self.old, self.young = self.young, _Known({"": b""})
            known, found, again = self.young, [], []
            for t in texts[at:end]:
                # letters fold one by one, without regard to where a sigma stands
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()
                words = t.replace("\n", " ").split(" ")
                ids = list(map(known.__getitem__, words))
                if None in ids:
                    again.append((ids, words))
                found.append(ids)
            new = []
            for w in known.missed:
                if (ids := self.old.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = ids
            known.missed = []
            self._learn(new)
            for ids, words in again:
                i = -1
                for _ in range(ids.count(None)):
                    i = ids.index(None, i + 1)
                    ids[i] = known[words[i]]
            out += map(b"".join, found)
            for w in new:
                if len(w) > CACHED_LETTERS:
                    del known[w]
        return out


class _Known(dict):
    """Ids by word; a word that is new stands with None and is noted."""

    def __init__(self, *a):
        super().__init__(*a)
        self.missed: list[str] = []

    def __missing__(self, word: str) -> None:
        self.missed.append(word)
        self[word] = None


def _tokenizer(path: str, cached_words: int) -> WordTokenizer:
    return worker_state(("packing", path, cached_words), lambda: WordTokenizer(path, cached_words))


def pieces(docs: DataFrame, tokenizer_path: str, p: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32 (and ids).

    Null text is empty; an empty text is the end id alone.
    """
    bounded(docs.sparkSession)
    cut, end = 4 * p.capacity, np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(tokenizer_path, p.cached_words)
        for b in batches:
            rows = []
            for d, ids in zip(b["doc_id"], tok.encode_batch(b["text"].tolist()), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), cut)):
                    part = ids[at : at + cut]
                    rows.append((d, n, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        release()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInPandas(run, kinds)


def _configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of bins of each filling, by column generation; at most ``need`` places of each size."""
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[i] * min(capacity // sizes[i], max(1, need[i])) for i in range(k)]
    basis = np.array(columns, float).T
    chosen = list(columns)
    want = np.array(need, float)
    order = np.argsort(sizes, kind="stable")
    by_size = ascending = np.array(sizes)[order]
    low = int(ascending[0])
    for _ in range(100 + 6 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        # the filling of the highest price: unbounded knapsack over the capacities
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(low, capacity + 1):
            fits = order[: np.searchsorted(ascending, c, "right")]
            worth = value[c - by_size[: len(fits)]] + price[fits]
            i = int(worth.argmax())
            value[c] = value[c - 1]
            if worth[i] > value[c] + 1e-12:
                value[c], last[c] = worth[i], fits[i]
        if value[capacity] <= 1 + 1e-9:
            break
        new, c = np.zeros(k, int), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                new[last[c]] += 1
                c -= sizes[last[c]]
        now, way = np.linalg.solve(basis, want), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(way > 1e-9, now / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], chosen[out] = new, new
    bins = np.maximum(0, np.floor(np.linalg.solve(basis, want) + 1e-9)).astype(int)
    return [(c, int(b)) for c, b in zip(chosen, bins, strict=True) if b]


def plan(histogram: dict[int, int], p: PackParams = PackParams()) -> list[tuple[tuple[int, ...], int]]:
    """Bins that hold every length as often as the histogram says: (lengths, how many such bins).

    Of the plans with each number of groups, the one with fewest bins.  Where
    few groups were asked for and much room stays, their number is doubled until
    it is FINE: uneven lengths in one group cost more room than they are worth.
    """
    plans = [_plan(histogram, p, g) for g in p.groups]
    size = lambda bins: sum(n for _, n in bins)
    best, g = min(plans, key=size), max(p.groups)
    least = max(-(-sum(n * c for n, c in histogram.items()) // p.capacity), sum(c for n, c in histogram.items() if 2 * n > p.capacity))
    while g < FINE and size(best) > least + least // 50 + 1:
        g *= 2
        best = min(best, _plan(histogram, p, g), key=size)
    return best


def _plan(histogram: dict[int, int], p: PackParams, n_groups: int) -> list[tuple[tuple[int, ...], int]]:
    cap = p.capacity
    left = {n: int(c) for n, c in histogram.items() if c > 0}
    if any(n > cap or n < 1 for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    done: list[tuple[tuple[int, ...], int]] = []
    if cap in left:
        done.append(((cap,), left.pop(cap)))
    large = sorted((n for n in left if n > cap // p.large), reverse=True)
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    total = sum(left[n] for n in large)
    if total:
        # groups of equal cardinality, longest first, split inside a length if need be
        groups: list[list[list[int]]] = [[]]
        share, room = -(-total // n_groups), -(-total // n_groups)
        for n in large:
            c = left[n]
            while c:
                if not room:
                    groups.append([])
                    room = share
                groups[-1].append([n, take := min(c, room)])
                c, room = c - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for g in groups:  # groups that are rounded to the same length are one
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        need = [sum(c for _, c in merged[s]) for s in sizes]
        for filling, count in _configurations(sizes, need, cap):
            slots = [i for i in range(len(sizes)) for _ in range(filling[i])]
            while count and slots:
                # the next runs of actual lengths, as many bins as all of them allow
                use = {i: slots.count(i) for i in set(slots)}
                slots = [i for i in slots if merged[sizes[i]]]
                if not slots:
                    break
                use = {i: slots.count(i) for i in set(slots)}
                m = min(count, *(merged[sizes[i]][0][1] // u for i, u in use.items()))
                got = []
                if m:
                    for i in slots:
                        run = merged[sizes[i]][0]
                        got.append(run[0])
                        run[1] -= m
                else:  # a run ends within one bin
                    m = 1
                    for i in slots:
                        if runs := merged[sizes[i]]:
                            got.append(runs[0][0])
                            runs[0][1] -= 1
                            if not runs[0][1]:
                                runs.pop(0)
                for s in sizes:
                    merged[s] = [r for r in merged[s] if r[1]]
                if got:
                    open_bins[cap - sum(got)].append((tuple(got), m))
                count -= m
        for n in large:
            left.pop(n)
        for runs in merged.values():
            for n, c in runs:
                left[n] = left.get(n, 0) + c

    rooms = sorted(r for r, v in open_bins.items() if v)

    def put(room: int, bins: tuple[tuple[int, ...], int]) -> None:
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append(bins)

    for n in sorted((n for n in left if n > cap // p.large), reverse=True):  # what the fillings left over: best fit
        c = left.pop(n)
        while c:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):  # the fullest bins that have room
                room = rooms[at]
                held, count = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            else:
                room, held, count = cap, (), c
            each = min(room // n, c)
            m = min(count, c // each)
            if count > m and held:
                put(room, (held, count - m))
            put(room - each * n, (held + (n,) * each, m))
            c -= each * m
    bins = [(room, *b) for room in sorted(open_bins) for b in open_bins[room]]
    return done + _fill_up(bins, left, cap)


def _fill_up(bins: list[tuple[int, tuple[int, ...], int]], left: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of small lengths: every run of equal bins gets the set of them that leaves least room, largest lengths first.

    Which sums the lengths from the k-th on can make is a bit set; a run of
    bins takes a set as often as lengths last.  What remains fills new bins.
    """
    sizes = sorted(left, reverse=True)
    full = (1 << (cap + 1)) - 1
    done, sums, known = [], [], None

    def copies(k: int) -> int:
        return min(left[sizes[k]], 4)

    todo = [(0, (), sum(left.values())), *reversed(bins)]  # the last is taken first; new bins come in the end
    while todo:
        room, held, count = todo.pop()
        if not held:
            count = sum(left.values())
            room = cap
            if not count:
                continue
        now = [copies(k) for k in range(len(sizes))]
        if now != known:
            if known is not None and any(c == 0 for c in now):
                sizes = [n for n in sizes if left[n]]
                now = [copies(k) for k in range(len(sizes))]
            sums = [1] * (len(sizes) + 1)
            for k in range(len(sizes) - 1, -1, -1):
                got, more, part = sums[k + 1], now[k], 1
                while more:  # copies by powers of two
                    part = min(part, more)
                    got |= got << part * sizes[k] & full
                    more, part = more - part, part * 2
                sums[k] = got
            known = now
        rest = (sums[0] & ((1 << (room + 1)) - 1)).bit_length() - 1
        if rest <= 0:
            done.append((held, count))
            continue
        chosen: list[tuple[int, int]] = []
        target = rest
        for k, n in enumerate(sizes):
            if not rest:
                break
            for j in range(min(now[k], rest // n), -1, -1):
                if sums[k + 1] >> (rest - j * n) & 1:
                    if j:
                        chosen.append((n, j))
                    rest -= j * n
                    break
        m = min(count, *(left[n] // j for n, j in chosen))
        if not held:  # no more new bins than could be filled
            m = min(m, -(-sum(n * c for n, c in left.items()) // cap))
        if held and count > m:
            todo.append((room, held, count - m))
        for n, j in chosen:
            left[n] -= j * m
        if not held:
            todo.append((0, (), 0))
        todo.append((room - target, held + tuple(n for n, j in chosen for _ in range(j)), m))
    return done


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, bins, first sequence, offset), sorted by length and rank."""
    used, rows, seq = defaultdict(int), [], 0
    for held, count in bins:
        at = 0
        for n in held:
            rows.append((n, used[n], count, seq, at))
            used[n] += count
            at += n
        seq += count
    a = np.array(rows, np.int64).reshape(-1, 5)
    return a[np.lexsort((a[:, 1], a[:, 0]))]


def pack(parts: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Repeated rows are packed as often as they stand.  No rows: no sequences.
    The plan that is broadcast has a row for each place in each kind of bin,
    which depends on the lengths that occur, at most ``capacity``, and not on
    the number of documents.
    """
    spark = parts.sparkSession
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan(hist, p)))
    # a length that many pieces have is dealt out by as many salts as its count asks for
    salts = spark.createDataFrame([(n, -(-c // p.rows_per_salt)) for n, c in hist.items()], "length long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    salted = parts.join(F.broadcast(salts), "length").withColumn("salt", salt).select(*parts.columns, "salt")  # at most capacity rows
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    ranked = salted.withColumn("rn", F.row_number().over(own)).join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rn") - 1).select(*parts.columns, "rank")
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = slots.value
        key = (s[:, 0] << 50) + s[:, 1]
        for b in batches:
            rank = b.pop("rank").to_numpy(np.int64)
            i = np.searchsorted(key, (b["length"].to_numpy(np.int64) << 50) + rank, "right") - 1
            yield b.assign(sequence_id=s[i, 3] + rank - s[i, 1], offset=s[i, 4])

    return ranked.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, p: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """Tokenize and pack every row of ``docs``."""
    return pack(save(pieces(docs, tokenizer_path, p, with_ids), "pieces", "zstd" if with_ids else "uncompressed"), p)
