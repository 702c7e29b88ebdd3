"""Pairs of texts whose sets of word shingles are alike, by Jaccard similarity.

At similarity 0.8 two 64-bit SimHash fingerprints differ in about ten bits and
up to seventeen; no table over parts of 64 bits is selective at such a radius.
So candidates come from many fingerprints, each made of the minima of a few
hash functions over the set: texts that share one are candidates, and every
candidate pair is verified by the true similarity of the whole sets.

First each set is compared with one other of each entry it shares, chosen by
hash; members that these links join need no further comparison.  The sets of
entries that hold several groups after that are not compared pair by pair.
They meet by their rarest shingles (prefix filtering): two sets of n and m
shingles with c or more in common share one of the n - c + 1 rarest of the one
and the m - c + 1 rarest of the other, so no similar pair is left out, whether
it shares an entry or not.  Near copies of one text meet only if the shingles
of their own are few; these are joined by the one among them that has fewest,
and only pairs of different groups are looked at afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, save, text_of
from .components import connected_components


@dataclass(frozen=True)
class SimilarParams:
    """least: the similarity as a fraction, in whole numbers; a pair at 0.8 shares one of the entries with probability 1 - (1 - 0.8^rows)^entries, 0.998."""

    words: int = 5
    least: tuple[int, int] = (4, 5)
    entries: int = 20
    rows: int = 6
    seed: int = 42


def hasher(p: SimilarParams):
    """Function from a set's hashes (distinct) to its keys, one an entry."""
    rng = np.random.default_rng(p.seed)
    flip, odd, mix = (rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (p.entries * p.rows, p.entries * p.rows, p.rows))

    def keys(h: np.ndarray) -> np.ndarray:
        least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 4_096):  # memory stays bounded for very long texts
            np.minimum(least, ((h[at : at + 4_096, None] ^ flip) * odd).min(axis=0), out=least)
        return (least.reshape(p.entries, p.rows) * mix).sum(axis=1, dtype=np.uint64)

    return keys


def _may(a: Column, b: Column, p: SimilarParams) -> Column:
    """Sets of these sizes can be so similar."""
    top, whole = p.least
    return F.least(a, b) * whole >= F.greatest(a, b) * top


def _meet(na: Column, at_a: Column, nb: Column, at_b: Column, p: SimilarParams) -> Column:
    """A shingle at these places of two sets, rarest first, can be the first that so similar sets share."""
    top, whole = p.least
    return _may(na, nb, p) & ((na + nb) * top <= F.least(na - at_a, nb - at_b) * (top + whole))


def _bounds(ratio: float = 1.1) -> np.ndarray:
    """Least size of each class of sizes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


def postings(sets: DataFrame, p: SimilarParams) -> DataFrame:
    """Rows (t, b, s, n, at, least): set ``s`` of ``n`` shingles has the shingle ``t`` at place ``at``, rarest first.

    ``sets`` has ``s`` and the distinct hashes ``h``.  ``b`` is the class of
    sizes of the smaller set of a pair: a set stands in its own class and in
    those of smaller sets that can be similar to it, in each as far as a first
    shared shingle can be; ``least`` where it can be the smaller set itself.
    Shingles that no other set has count for the places but get no row.
    """
    top, whole = p.least
    bounds = _bounds()

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, n, h in zip(b["s"], b["n"], b["h"], strict=True):
                h, before, small = np.asarray(h, np.int64), n - len(h), -(-top * n // whole)
                first, own = (np.searchsorted(bounds, [small, n], "right") - 1).tolist()
                for k in range(first, own + 1):
                    last = n - -(-top * (n + max(int(bounds[k]), small)) // (top + whole))
                    at = np.arange(before, min(last + 1, n))
                    if len(at):
                        least = (at <= n - -(-top * 2 * n // (top + whole))) if k == own else np.zeros(len(at), bool)
                        out.append((h[: len(at)], np.full(len(at), k), np.full(len(at), s), np.full(len(at), n), at, least))
            if out:
                yield pd.DataFrame(dict(zip(("t", "b", "s", "n", "at", "least"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
        release()

    # how many sets have a shingle; a part of them at a time, so that a very common one is no single list
    owners = sets.select("s", F.explode("h").alias("t")).groupBy("t", F.pmod("s", F.lit(64)).alias("part")).agg(F.collect_list("s").alias("own"))
    owners = owners.withColumn("sets", F.sum(F.size("own")).over(Window.partitionBy("t"))).where("sets > 1")
    shared = owners.select(F.explode("own").alias("s"), "sets", "t").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("sets", "t"))).alias("h"))
    sized = sets.select("s", F.size("h").cast("long").alias("n"))
    return shared.select("s", F.col("h.t").alias("h")).join(sized, "s").select("s", "n", "h").mapInPandas(places, "t long, b long, s long, n long, at long, least boolean")


def _several(posts: DataFrame, left: DataFrame, order: Column) -> DataFrame:
    """Rows of ``posts`` with the roots in ``left``, where a shingle and class have several, and ``lead``: the least by ``order`` that can be the smaller set."""
    here = posts.join(left.select("s", "root"), "s")
    lead = F.min(F.when(F.col("least"), F.struct(order.alias("order"), "s", "n", "at", "root"))).alias("lead")
    keys = here.groupBy("t", "b").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), lead).where("lo <> hi and lead is not null")
    return here.join(keys.select("t", "b", "lead"), ["t", "b"])


def lead_pairs(posts: DataFrame, left: DataFrame, turn: int, p: SimilarParams) -> DataFrame:
    """Pairs (a, b) of different roots: each set with one other for each of its rarest shingles.

    In turn 0 that is the one with the fewest rarer shingles, which of near
    copies is the nearest to what they have in common; later it goes by hash.
    """
    order = F.col("at") if turn == 0 else F.xxhash64("s", "t", F.lit(turn))
    met = _several(posts, left, order)
    met = met.where((F.col("root") != F.col("lead.root")) & _meet(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), p))
    return met.select(F.least("s", "lead.s").alias("a"), F.greatest("s", "lead.s").alias("b")).distinct()


def rest_pairs(posts: DataFrame, left: DataFrame, p: SimilarParams) -> DataFrame:
    """Pairs (a, b) of different roots among the sets of ``left`` (s, root): all that are similar are among them.

    Members of the lead's root are not put beside each other.
    """
    met = save(_several(posts, left, F.col("at")).withColumn("out", F.col("root") != F.col("lead.root")).drop("lead"), "similar-met")
    named = lambda x: [F.col(c).alias(c + x) for c in ("s", "n", "at", "root")]
    small = met.where("least").select("t", "b", F.col("out").alias("side"), *named("a"))
    sides = F.explode(F.when(F.col("out"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("side")
    both = small.join(met.select("t", "b", sides, *named("b")), ["t", "b", "side"])
    after = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("sa") < F.col("sb"))
    both = both.where(after & (F.col("roota") != F.col("rootb")) & _meet(F.col("na"), F.col("ata"), F.col("nb"), F.col("atb"), p))
    return both.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()


def links(docs: DataFrame, marked: DataFrame, p: SimilarParams) -> DataFrame:
    """Pairs (a, b) of fingerprints ``fp`` that texts of equal or similar sets join.

    ``marked`` is saved and has doc_id, th, fp of the rows of ``docs``, and of
    their shingle sets a hash ``s``, the size ``n`` and the ``keys``.  Empty sets link nothing.
    """
    from .simhash import shingles

    full = marked.where("n > 0")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "fp", "n", "keys")).alias("one")
    own = save(full.groupBy("s").agg(one).select("s", "one.*"), "similar-sets")
    rows = own.select("s", "n", F.explode("keys").alias("key"))
    lead = F.min(F.struct(F.xxhash64("s", "key").alias("h"), "s", "n")).alias("lead")
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), lead).where("members > 1").select("key", F.col("lead.s").alias("lead"), F.col("lead.n").alias("lead_n"))
    held = save(rows.join(shared, "key"), "similar-entries")

    # the sets themselves, of texts that share an entry
    asked = own.join(held.select("s").distinct(), "s", "left_semi")
    asked = asked.select("s", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("none").alias("_none"), F.col("th").alias("_th"))
    text = text_of(F.col("text"))
    raw = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64(text).alias("_th"), text.alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(h=[np.unique(shingles(t, p.words)).view(np.int64) for t in b.pop("text")])
        release()

    found = raw.join(asked, ["_id", "_none", "_th"]).select("s", "text").mapInPandas(sets, "s long, h array<long>")
    whole = save(found.dropDuplicates(["s"]), "similar-hashes", "zstd")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(whole.select(F.col("s").alias("a"), F.col("h").alias("ha")), "a").join(whole.select(F.col("s").alias("b"), F.col("h").alias("hb")), "b")
        top, bottom = p.least
        common = F.size(F.array_intersect("ha", "hb"))
        return save(both.where(common * (top + bottom) >= (F.size("ha") + F.size("hb")) * top).select("a", "b"), name)

    first = held.where((F.col("s") != F.col("lead")) & _may(F.col("n"), F.col("lead_n"), p))
    first = save(first.select(F.least("s", "lead").alias("a"), F.greatest("s", "lead").alias("b")).distinct(), "similar-first")
    near = verified(first, "similar-links")
    roots = connected_components(near).withColumnRenamed("node", "s")
    placed = held.select("key", "s").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
    placed = save(placed, "similar-placed")
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = save(placed.join(apart, "key", "left_semi").select("s", "root").distinct(), "similar-left")
    posts = save(postings(whole.join(left.select("s"), "s", "left_semi"), p), "similar-postings")
    turn, going = 0, True
    while going:  # as long as many of the pairs are links
        tried = save(lead_pairs(posts, left, turn, p), "similar-tried")
        more = verified(tried, "similar-more")
        near, found = near.union(more), more.count()
        if found:
            ends = more.join(left.select(F.col("s").alias("a"), F.col("root").alias("ra")), "a").join(left.select(F.col("s").alias("b"), F.col("root").alias("rb")), "b")
            tops = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
            left = save(left.join(tops, "root", "left").select("s", F.coalesce("top", "root").alias("root")), "similar-left")
        turn, going = turn + 1, found * 20 > tried.count()
    near = near.union(verified(rest_pairs(posts, left, p), "similar-rest"))

    at = own.select("s", "fp")
    joined = near.join(at.select(F.col("s").alias("a"), F.col("fp").alias("fa")), "a").join(at.select(F.col("s").alias("b"), F.col("fp").alias("fb")), "b")
    same = full.select("s", F.col("fp").alias("a")).distinct().join(at.withColumnRenamed("fp", "b"), "s").where("a <> b")  # equal sets
    return joined.select(F.col("fa").alias("a"), F.col("fb").alias("b")).union(same.select("a", "b"))
