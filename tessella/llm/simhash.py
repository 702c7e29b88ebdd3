"""SimHash near-duplicates with multi-index hashing.

Fingerprints are equal first, then near: distinct 64-bit fingerprints stand in
two tables, one by their upper and one by their lower half.  Two fingerprints
at most two bits apart either have equal lower halves, or upper halves at most
one bit apart; so each fingerprint enumerates the Hamming ball of radius one
around its upper half (and of radius zero around its lower half), fetches the
matches from the tables and verifies the complete distance.

A table entry that many fingerprints share is not compared pair by pair.  Its
members probe the entries of other, smaller upper halves in both directions;
among themselves they use finer tables, one for each 16 bits left out, where
the ball of radius one around the 48 bits that remain holds every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, release, save, text_of, whole_ids, worker_state
from .components import connected_components
from .similar import SimilarParams, hasher
from .similar import links as similar_links

WORD_SEED = 42
SHINGLE = 3
RADIUS = 2
#: Entries with more distinct fingerprints than this use the finer tables.
HOT_ENTRY = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at bytes 9-13 and 32
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    del words
    return np.fromiter((digest(joined[a:b], WORD_SEED) for a, b in zip(start[: len(start) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)), np.uint64, len(start) - k + 1)


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    h = shingles(text, n)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # a block's bits at a time; the digests are 8 bytes a word
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, similar: SimilarParams | None = None) -> DataFrame:
    """doc_id, ``fp`` (signed 64 bit) and ``th`` (hash of the text) of every row; null text is empty.

    With ``similar`` also a hash ``s`` of the set of its shingles, the set's size ``n`` and its ``keys``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        worker_state(("simhash",), dict)  # an earlier stage's words go
        keys = hasher(similar) if similar else None
        for b in batches:
            texts = b.pop("text")
            b = b.assign(fp=np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            if similar:
                s, n, k = [], [], []
                for t in texts:
                    h = np.unique(shingles(t, similar.words))
                    s.append(xxhash.xxh64_intdigest(h.tobytes()))
                    n.append(len(h))
                    k.append(keys(h).view(np.int64))
                b = b.assign(s=np.array(s, np.uint64).view(np.int64), n=np.array(n, np.int64), keys=k)
            yield b
        release()

    bounded(whole_ids(docs).sparkSession)
    text, kinds = text_of(F.col("text")), "doc_id long, th long, fp long" + ", s long, n long, keys array<long>" * (similar is not None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInPandas(run, kinds)


_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_KEPT = [~(np.uint64(0xFFFF) << np.uint64(16 * i)) for i in range(4)]


def _probe_upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys at most one bit from a fingerprint's upper half.

    Of two keys one bit apart, one is the other with a bit set; so a member of
    a small entry only sets bits.  A member of a large entry, whose own entry
    is in no table, sets and clears them.
    """
    bits = _ONE[32:]
    for b in batches:
        every, large = b["fp"].to_numpy(np.int64).view(np.uint64), b["hot_u"].to_numpy(bool)
        for at in range(0, len(every), 5_000):
            fp, wide = every[at : at + 5_000], large[at : at + 5_000]
            row, col = np.nonzero(((fp[:, None] & bits) == 0) | wide[:, None])
            own = np.nonzero(~wide)[0]
            key = np.concatenate([fp[own], fp[row] ^ bits[col]]) >> np.uint64(32)
            yield pd.DataFrame({"key": key.astype(np.int64), "a": fp[np.concatenate([own, row])].view(np.int64)})


def _probe_fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each 16 bits left out, the other 48 bits as they are and with one more bit set."""
    for b in batches:
        every = b["fp"].to_numpy(np.int64).view(np.uint64)
        for at in range(0, len(every), 2_000):
            fp = every[at : at + 2_000]
            for out, kept in enumerate(_KEPT):
                bits = _ONE[(_ONE & kept) != 0]
                row, col = np.nonzero((fp[:, None] & bits) == 0)
                key = np.concatenate([fp & kept, (fp[row] & kept) | bits[col]])
                yield pd.DataFrame({"out": out, "key": key.view(np.int64), "a": np.concatenate([fp, fp[row]]).view(np.int64)})


def links(distinct: DataFrame, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most RADIUS bits apart.

    ``distinct`` has a column ``fp``, unique and saved.  No link is lost.  No
    half that more than ``hot_entry`` fingerprints share is compared pair by
    pair; the finer keys of those keep 48 bits, so that who shares one differs
    in the other 16 bits alone.
    """
    halves = distinct.select("fp", F.shiftrightunsigned("fp", 32).alias("u"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("l"))
    large = lambda c: halves.groupBy(c).count().where(F.col("count") > hot_entry).select(c, F.lit(True).alias(f"hot_{c}"))
    d = halves.join(large("u"), "u", "left").join(large("l"), "l", "left").na.fill(False, ["hot_u", "hot_l"])
    d = save(d.select("fp", "u", "l", "hot_u", "hot_l"), "simhash-halves")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS

    table_u = d.where("not hot_u").select(F.col("u").alias("key"), F.col("fp").alias("b"))
    found_u = d.select("fp", "hot_u").mapInPandas(_probe_upper, "key long, a long").join(table_u, "key").where((F.col("a") != F.col("b")) & near)
    table_l = d.where("not hot_l").select(F.col("l").alias("key"), F.col("fp").alias("b"))
    found_l = table_l.withColumnRenamed("b", "a").join(table_l, "key").where((F.col("a") < F.col("b")) & near)
    h = d.where("hot_u or hot_l").select("fp")
    fine = h.select(F.col("fp").alias("b"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(int(k.view(np.int64))) for k in _KEPT])).alias("out", "key"))
    found_h = h.mapInPandas(_probe_fine, "out int, key long, a long").join(fine, ["out", "key"]).where((F.col("a") != F.col("b")) & near)
    pairs = found_u.select("a", "b").union(found_l.select("a", "b")).union(found_h.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, hot_entry: int, similar: SimilarParams | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) of every row, and (fp, root) of every distinct fingerprint."""
    fps = save(fingerprints(docs, similar), "simhash-fp")
    distinct = save(fps.select("fp").distinct(), "simhash-distinct")
    pairs = save(links(distinct, hot_entry), "simhash-links")
    if similar:
        pairs = save(pairs.union(similar_links(docs, fps, similar)), "simhash-similar")
    roots = connected_components(pairs).withColumnRenamed("node", "fp")  # only of fingerprints that have links
    return fps, save(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, hot_entry: int = HOT_ENTRY, similar: SimilarParams | None = None) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row.

    Null text is empty; empty texts have fingerprint zero and link like any
    other.  Repeated rows keep one result each.  A null doc_id takes part but
    is never the smallest; a component of only such rows has a null id; a
    doc_id that is no whole number is a TypeError.  With ``similar``, texts of
    so similar shingle sets link too.
    """
    fps, roots = _grouped(docs, hot_entry, similar)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    ids = save(least, "simhash-least").groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(roots.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, hot_entry: int = HOT_ENTRY, similar: SimilarParams | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest doc_id (null last), of it the smallest text hash."""
    fps, roots = _grouped(docs, hot_entry, similar)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = fps.groupBy("fp").agg(F.min(order).alias("one")).join(roots, "fp").groupBy("root").agg(F.min("one").alias("one"))
    kept = best.select(F.coalesce("one.doc_id", F.lit(0)).alias("_id"), F.col("one.none").alias("_none"), F.col("one.th").alias("_th"))
    own = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull(), "_th": F.xxhash64(text_of(F.col("text")))})
    return own.join(kept, ["_id", "_none", "_th"], "left_semi").dropDuplicates(["_id", "_none", "_th"]).drop("_id", "_none", "_th")


def hex16(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
