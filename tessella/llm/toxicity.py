"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of itself and its character
n-grams, all hashed into one table.  A text's vector is the mean over its
words, each weighted by the square root of its count, and a few zero vectors,
which keep texts of two or three words near the prior.  Two output vectors and
a bias make the softmax.  Table and output are trained jointly, in numpy, on a
bounded sample of labelled rows.  A misspelled word that was never seen shares
n-grams with words that were.

Most n-grams of a sample tell nothing and would learn single texts by heart.
So only buckets whose gradient at the prior stands out of its own noise are
trained; how far out, and for how many steps, a held-out part of the sample
decides.

Everything runs on arrays of code points, blocks of texts at a time: no object
for each word and no cache of words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, release, text_of, worker_state

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Letters of texts and of distinct words that are worked on at once.
BLOCK = 500_000


@dataclass(frozen=True)
class ToxicityParams:
    """toxic_rows, clean_rows and max_chars bound the labelled sample; zeros: how many zero
    vectors are averaged in; noise: multiples of a gradient's standard deviation from
    which on a bucket is trained, steps: training steps; of both the inner split chooses."""

    toxic_rows: int = 1_600
    clean_rows: int = 3_000
    max_chars: int = 8_000_000
    buckets: int = 1 << 18
    zeros: float = 5.0
    noise: tuple[float, ...] = (2.0, 3.0, 4.0)
    steps: tuple[int, ...] = (20, 30, 40, 60)
    toxic_weight: float = 0.5
    dim: int = 8
    n_min: int = 2
    n_max: int = 5
    rate: float = 0.1
    decay: float = 1e-5
    scale: float = 30.0
    threshold: float = 0.7
    seed: int = 42


@dataclass(frozen=True)
class ToxicityModel:
    """weight: each bucket's part of the logit (its vector times the difference of the output vectors)."""

    weight: np.ndarray
    bias: float
    params: ToxicityParams
    noise: float = 0.0
    steps: int = 0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


_ALNUM: list[np.ndarray] = []


def _letter() -> np.ndarray:
    """Which code points are letters or digits."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _ALNUM[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), _MUL))


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first, first + 1, .. of runs of these sizes, and each one's place in its run."""
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(first, size) + place, place


class Words:
    """The words of some texts: letters ``cp``, and of each word its first letter, its size, its text and its hash.

    Lower case; a word is a run of letters and digits, however long.
    """

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.cp = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        turn = np.diff(np.concatenate([[False], _letter()[self.cp], [False]]).astype(np.int8))
        self.start = np.flatnonzero(turn == 1)
        self.size = np.flatnonzero(turn == -1) - self.start
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), self.start, "right")
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at, place = _spread(self.start, self.size)
        first = np.cumsum(self.size) - self.size
        return _mixed(np.add.reduceat((self.cp[at].astype(np.uint64) + np.uint64(1)) * _powers(int(self.size.max()))[place], first))

    def grams(self, of: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, position in ``of``) of every n-gram, repeats included, and of the whole word, of words ``of``."""
        size = self.size[of] + 2  # with a mark at either end
        at, place = _spread(self.start[of] - 1, size)
        flat = self.cp[np.clip(at, 0, max(0, len(self.cp) - 1))].astype(np.uint64) + np.uint64(3)
        first = np.cumsum(size) - size
        flat[first], flat[first + size - 1] = 1, 2
        left, owner = np.repeat(size, size) - place, np.repeat(np.arange(len(of)), size)
        h, power = np.zeros(len(flat), np.uint64), _powers(p.n_max + 1)
        found, own = [_mixed(self.hash[of] ^ np.uint64(77))], [np.arange(len(of))]
        for n in range(1, p.n_max + 1):
            h[: max(0, len(h) - n + 1)] += flat[n - 1 :] * power[n - 1]
            if n >= p.n_min:
                whole = np.flatnonzero(left >= n)
                found.append(_mixed(h[whole] * np.uint64(2 * n + 1)))
                own.append(owner[whole])
        return (np.concatenate(found) % np.uint64(p.buckets)).astype(np.int32), np.concatenate(own)

    def blocks(self, of: np.ndarray) -> Iterator[np.ndarray]:
        """``of`` in parts of about BLOCK letters."""
        upto = np.cumsum(self.size[of])
        cuts = np.flatnonzero(np.diff(upto // BLOCK)) + 1
        yield from (part for part in np.split(of, cuts) if len(part))


def _bags(texts: list[str], zeros: float) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, positions of the distinct ones, and (text, distinct word, share) of each word in each text."""
    w = Words(texts)
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    key, count = np.unique(w.text * max(1, len(first)) + inverse, return_counts=True)
    text, word = np.divmod(key, max(1, len(first)))
    value = np.sqrt(count)
    return w, first, text, word, value / (np.bincount(text, value, len(texts)) + zeros)[text]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about BLOCK letters."""
    size = np.cumsum([len(t) for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), len(texts)]
    yield from ((a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a)


class _Sample:
    """Texts as sparse shares of words, and words as bags of buckets, sorted by word.

    Texts are taken in blocks, so that what is held grows with the distinct
    words alone.
    """

    def __init__(self, texts: list[str], y: np.ndarray, p: ToxicityParams):
        known: dict[int, int] = {}
        text, word, share, gram, size = [], [], [], [], []
        for a, z in _blocks(texts):
            w, first, t, own, value = _bags(texts[a:z], p.zeros)
            before = len(known)
            at = np.array([known.setdefault(h, len(known)) for h in w.hash[first].tolist()], np.int32)
            text.append((t + a).astype(np.int32))
            word.append(at[own])
            share.append(value.astype(np.float32))
            for part in w.blocks(first[at >= before]):  # words that are new, in their order
                g, o = w.grams(part, p)
                gram.append(g[np.argsort(o, kind="stable")])
                size.append(np.bincount(o, minlength=len(part)).astype(np.int32))
        self.y, self.n_words = y, len(known)
        del known

        def join(parts: list[np.ndarray], kind: type) -> np.ndarray:
            out = np.concatenate(parts) if parts else np.zeros(0, kind)
            parts.clear()
            return out

        gram, self.size = join(gram, np.int32), join(size, np.int32)
        self.text, self.word, self.share = join(text, np.int32), join(word, np.int32), join(share, np.float32)
        own = np.repeat(np.arange(self.n_words, dtype=np.int32), self.size)
        texts_with = np.bincount(self.word, minlength=self.n_words).astype(np.int32)
        uses = np.zeros(p.buckets)
        for k in range(0, len(gram), 1 << 20):
            uses += np.bincount(gram[k : k + (1 << 20)], texts_with[own[k : k + (1 << 20)]], p.buckets)
        often = uses > 2  # two uses are never more than noise
        keep = often[gram]
        self.used = np.flatnonzero(often)
        gram = gram[keep]
        self.own = own[keep]
        del own, keep
        self.gram = (np.cumsum(often, dtype=np.int32) - 1)[gram]

    def rows(self, of: np.ndarray) -> "_Part":
        return _Part(self, of)


class _Part:
    """The texts ``of`` of a sample."""

    def __init__(self, sample: _Sample, of: np.ndarray):
        place = np.full(len(sample.y), -1, np.int32)
        place[of] = np.arange(len(of))
        mine = place[sample.text] >= 0
        self.sample, self.y = sample, sample.y[of]
        self.text, self.word, self.share = place[sample.text[mine]], sample.word[mine], sample.share[mine]

    def weights(self, p: ToxicityParams) -> np.ndarray:
        y = self.y
        return np.where(y > 0, p.toxic_weight / max(1, y.sum()), (1 - p.toxic_weight) / max(1, (1 - y).sum()))

    def noise(self, p: ToxicityParams) -> np.ndarray:
        """Each used bucket's gradient at the prior as a multiple of its standard deviation."""
        s, n_used = self.sample, max(1, len(self.sample.used))
        delta = (p.toxic_weight - self.y) * self.weights(p)
        total, square = np.zeros(n_used), np.zeros(n_used)
        first = np.searchsorted(s.own, np.arange(s.n_words + 1))
        bound = np.searchsorted(self.text, np.arange(len(self.y) + 1))
        step = max(1, (1 << 21) // n_used)
        for a in range(0, len(self.y), step):
            z = min(len(self.y), a + step)
            sl = slice(bound[a], bound[z])
            word = self.word[sl]
            count = first[word + 1] - first[word]
            at, _ = _spread(first[word], count)
            cell = np.repeat(self.text[sl] - a, count) * n_used + s.gram[at]
            phi = np.bincount(cell, np.repeat(self.share[sl] / s.size[word], count), (z - a) * n_used).reshape(z - a, n_used)
            total += delta[a:z] @ phi
            square += delta[a:z] ** 2 @ phi**2
        return np.abs(total) / np.sqrt(square + 1e-300)

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """``weight``: of the sample's used buckets."""
        s = self.sample
        word = np.bincount(s.own, weight[s.gram], s.n_words) / s.size
        return np.bincount(self.text, word[self.word] * self.share, len(self.y)) + bias


def _descend(part: _Part, chosen: np.ndarray, steps: tuple[int, ...], p: ToxicityParams) -> Iterator[tuple[int, np.ndarray, float]]:
    """Full-batch Adam on the cross entropy of the chosen buckets: after each number of steps, weights and bias."""
    s, y, share = part.sample, part.y, part.weights(p)
    mine = chosen[s.gram]
    own = s.own[mine]
    which = np.flatnonzero(chosen)
    gram = (np.cumsum(chosen, dtype=np.int32) - 1)[s.gram[mine]]
    rng = np.random.default_rng(p.seed)
    vectors = rng.normal(0, 0.1, (len(which), p.dim))
    out = rng.normal(0, 0.1, p.dim)  # difference of the two classes' output vectors
    bias = np.zeros(1)
    mean, var = ([np.zeros_like(x) for x in (vectors, out, bias)] for _ in range(2))
    for t in range(1, max(steps) + 1):
        # a word's logit is the mean over its buckets of vector times output
        word = np.bincount(own, (vectors @ out)[gram], s.n_words) / s.size * p.scale
        z = np.bincount(part.text, word[part.word] * part.share, len(y)) + bias
        delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        pull = np.bincount(part.word, delta[part.text] * part.share, s.n_words) / s.size * p.scale
        pull = np.bincount(gram, pull[own], len(which))
        slopes = pull[:, None] * out + p.decay * vectors, vectors.T @ pull + p.decay * out, delta.sum(keepdims=True)
        for x, g, m, v in zip((vectors, out, bias), slopes, mean, var, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if t in steps:
            weight = np.zeros(max(1, len(s.used)))
            weight[which] = vectors @ out * p.scale
            yield t, weight, float(bias[0])


def _worth(part: _Part, weight: np.ndarray, bias: float, p: ToxicityParams) -> tuple[float, float]:
    """F1 at the threshold, then the weighted likelihood."""
    z = np.clip(part.logits(weight, bias), -30, 30)
    prob = 1 / (1 + np.exp(-z))
    said = prob >= p.threshold
    hit = float((said & (part.y > 0)).sum())
    like = float((part.weights(p) * np.log(np.where(part.y > 0, prob, 1 - prob))).sum())
    return round(2 * hit / max(1.0, said.sum() + part.y.sum()), 3), like


def train(texts: list[str], labels: np.ndarray, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Noise bound and steps by the texts whose hash modulo 4 is 0 (equal texts stay together), then all texts.

    No text, or one class alone: a constant model.  No inner split with both
    classes on both sides: the first noise bound and number of steps.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(p.buckets, np.float32), 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1), p)
    sample = _Sample(texts, y, p)
    if not len(sample.used):
        return ToxicityModel(np.zeros(p.buckets, np.float32), 0.0, p)
    inner = _text_hash(texts) % 4 == 0
    best = (p.noise[0], p.steps[0])
    if all(len(set(y[side])) == 2 for side in (inner, ~inner)):
        left, right = sample.rows(np.flatnonzero(~inner)), sample.rows(np.flatnonzero(inner))
        noise, tried = left.noise(p), {}
        for bound in p.noise:
            for t, weight, bias in _descend(left, noise >= bound, p.steps, p):
                tried[bound, t] = _worth(right, weight, bias, p)
        best = max(tried, key=tried.get)
        del left, right
    every = sample.rows(np.arange(len(y)))
    (_, weight, bias), = _descend(every, every.noise(p) >= best[0], (best[1],), p)
    table = np.zeros(p.buckets, np.float32)
    table[sample.used] = weight
    return ToxicityModel(table, bias, p, *best)


def _text_hash(texts: list[str]) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts])


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1; others and nulls are left out).

    The sample: of each label the documents whose id hashes lowest, whole
    texts, in this order up to half of max_chars.  Spark keeps each task's
    lowest ids alone, so no task sorts a whole label; texts are looked up by a
    broadcast of the chosen ids.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    known = marked.join(docs.select("doc_id").distinct(), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    lowest = lambda y, n: known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n)
    ids = [tuple(r) for y, n in ((1, p.toxic_rows), (0, p.clean_rows)) for r in lowest(y, n).select("doc_id", "toxic", "h").collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame(ids, known.select("doc_id", "toxic", "h").schema)
    rows = docs.select("doc_id", text_of(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most toxic_rows + clean_rows ids
    own = rows.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t", "toxic"])
    order = Window.partitionBy("toxic").orderBy("h", "doc_id", "t")
    some = own.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).where(F.col("before") < p.max_chars // 2)
    data = some.orderBy("h", "doc_id", "t", "toxic").select("text", "toxic").collect()
    model = train([r.text for r in data], np.array([r.toxic for r in data], float), p)
    release()
    return model


def scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    """Score of each text; what a text gets doesn't depend on the texts beside it."""
    p, weight = model.params, model.weight.astype(float)
    out = np.empty(len(texts))
    for a, z in _blocks(texts):
        w, first, text, word, share = _bags(texts[a:z], p.zeros)
        own = [np.zeros(0)]
        for part in w.blocks(first):
            g, o = w.grams(part, p)
            own.append(np.bincount(o, weight[g], len(part)) / np.bincount(o, minlength=len(part)))
        out[a:z] = np.bincount(text, np.concatenate(own)[word] * share, z - a)
    return 1 / (1 + np.exp(-np.clip(np.round(out, 9) + model.bias, -30, 30)))


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted (1 from the threshold on).

    A text without words (null, empty) scores by the bias alone.  Repeated
    rows repeat; other columns are not looked at.
    """
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)  # buckets * 4 bytes

    @F.pandas_udf("score double, predicted int")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_state(("toxicity",), dict)  # an earlier stage's words go
        for b in batches:
            s = scores(b.tolist(), sent.value)
            yield pd.DataFrame({"score": s, "predicted": (s >= sent.value.params.threshold).astype(np.int32)})
        release()

    out = docs.select(*keep, said.asNondeterministic()(text_of(F.col("text"))).alias("_said"))  # once a row, whatever is asked of it
    return out.select(*keep, "_said.score", "_said.predicted")
