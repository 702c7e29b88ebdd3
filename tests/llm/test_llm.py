"""Operators of the pipeline against brute force, and on odd tables."""

import hashlib
import io
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import ann, common, htmltext, langid, linededup, media, packing, sentencepiece, similar, simhash, toxicity, warc
from tessella.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, h long, rn int, fp long, m int"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "Ä ß 漢字 🎉", "same same", "same same", "x " * 5_000, "\t|\x00|\x1f", "<|endoftext|>"]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, null ids, clashing columns."""
    return docs(spark, ODD + ["same same", "no id", None], [*range(len(ODD)), 6, None, None])


# ---- op1


def encoder():
    return sentencepiece._encoder(P.path("piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aeinorsth THE  ▁.,'-0é中\n\t🎉"), max_size=60))
def test_sentencepiece_is_exact(text):
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = np.frombuffer(encoder().encode_batch([text])[0], "<u4").tolist()
    assert ids == sp.encode(text)
    assert sentencepiece.Decoder(encoder().model).decode(np.array(ids, int)) == sp.decode(ids)


def test_unigram_viterbi():
    from itertools import combinations

    pieces = ["<unk>", *"abc", "ab", "bc", "abc", "ca", "aa"]
    scores = np.array([0, -2.0, -2.1, -2.2, -3.0, -2.9, -4.6, -3.5, -3.3])
    m = sentencepiece.Model(pieces, scores, np.array([2] + [1] * 8), bpe=False, dummy_prefix=False, extra_spaces=False, escape=False, ids={p: i for i, p in enumerate(pieces)})
    e = sentencepiece.Encoder(m)

    def best(word):
        top = None
        for n in range(len(word)):
            for cut in combinations(range(1, len(word)), n):
                parts = [word[a:b] for a, b in zip((0, *cut), (*cut, len(word)), strict=True)]
                if all(p in m.ids for p in parts):
                    s = sum(scores[m.ids[p]] for p in parts)
                    top = max(top or (-1e9, []), (s, parts))
        return top[0]

    for w in ("abc", "abcab", "caabc", "aaaa", "bcabca"):
        ids = np.frombuffer(e.encode_batch([w])[0], "<u4")
        assert "".join(pieces[i] for i in ids) == w
        assert sum(scores[i] for i in ids) == pytest.approx(best(w))
    assert np.frombuffer(e.encode_batch(["axxb"])[0], "<u4").tolist() == [1, 0, 2]


def test_sentencepiece_rows(spark):
    path = P.path("piece_bpe_32k.model")
    got = sentencepiece.round_trip(odd(spark), path).collect()
    assert len(got) == len(ODD) + 3 and all(r.lossless for r in got)
    ids = sentencepiece.encode(odd(spark), path)
    back = sentencepiece.decode(ids, path).collect()
    assert sorted((r.text or "") for r in back) == sorted((t or "") for t in [*ODD, "same same", "no id", None])
    assert sentencepiece.round_trip(docs(spark, []), path).count() == 0


# ---- op2


def test_media_formats():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0x7F], mu[0xFF]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    data = bytes(range(256)) * 3
    for kind in (media.MULAW, media.ALAW):
        assert bytes(media.parse(media.wav(data, kind))[3]) == data
    for broken in (b"", b"RIFF", media.wav(data, media.MULAW)[:100]):
        with pytest.raises(ValueError):
            media.parse(broken)


def test_adpcm_blocks_match_a_plain_decoder():
    rng = np.random.default_rng(3)
    block = 36
    raw = bytearray(rng.integers(0, 256, block * 5 + 20, dtype=np.uint8).tobytes())
    for k in range(0, len(raw), block):
        raw[k + 2] %= 89

    def plain(b):
        value, index = int.from_bytes(b[:2], "little", signed=True), b[2]
        out = [value]
        for code in (c for x in b[4:] for c in (x & 15, x >> 4)):
            step = int(media._STEP[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(media._INDEX_STEP[code])))
            out.append(value)
        return out

    want = [v for k in range(0, len(raw), block) for v in plain(bytes(raw[k : k + block]))]
    assert media.decode_adpcm([bytes(raw)], block)[0].tolist() == want
    (x, rate, _), = media.samples([media.wav(bytes(raw), media.ADPCM, 8000, block)])
    assert rate == 8000 and x.tolist() == want
    cuts = [bytes(raw[: block * k + r]) for k, r in ((0, 0), (0, 3), (1, 0), (2, 5), (5, 20))]
    for got, c in zip(media.decode_adpcm(cuts, block), cuts, strict=True):  # many clips at once
        assert got.tolist() == [v for k in range(0, len(c), block) if len(c) - k >= 4 for v in plain(c[k : k + block])]


def test_resample_is_plain():
    x = np.random.default_rng(1).integers(-32768, 32768, 101).astype(np.int16)
    for rate, to in ((8000, 16000), (8000, 11025)):
        pos = [k * rate for k in range(101 * to // rate)]
        assert media.resample(x, rate, to).tolist() == [(int(x[q // to]) * (to - q % to) + int(x[min(100, q // to + 1)]) * (q % to)) // to for q in pos]
    for rate, to in ((8000, 1000), (8000, 3000), (44100, 8000)):
        n = 101 * to // rate
        spans = [x[k * rate // to : (k + 1) * rate // to].astype(int) for k in range(n)]
        assert media.resample(x, rate, to).tolist() == [int(s.sum()) // len(s) for s in spans]
    assert media.resample(x[:3], 8000, 1000).tolist() == [int(x[:3].astype(int).sum()) // 3]


def test_media_rows(spark):
    got = media.text_media(odd(spark)).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        kind = (media.MULAW, media.ALAW, media.ADPCM)[zlib.crc32(pay) % 3]
        clip = media.wav(pay, kind, block=192 if kind == media.ADPCM else None)
        assert (r.media_bytes, r.media_sha256) == (len(clip), hashlib.sha256(clip).hexdigest())
        x = media.decode_adpcm([pay], 192)[0] if kind == media.ADPCM else media._TABLES[kind][np.frombuffer(pay, np.uint8)]
        pcm = media.wav(media.resample(x, 8000, 1000).astype("<i2").tobytes(), media.PCM, 1000)
        assert r.feature == media.feature(x, 8000) and r.pcm_sha256 == hashlib.sha256(pcm).hexdigest()
    assert len({zlib.crc32(media.payload_of(t)[0]) % 3 for t in ODD}) == 3  # all formats stand in the table
    assert by[6].feature == by[7].feature
    pcm = media.to_pcm(media.store_texts(odd(spark))).first()
    assert media.parse(pcm.media)[:2] == (media.PCM, 16000)
    good = media.wav(bytes(range(200)), media.PCM)
    fmt = good.index(b"fmt ")
    broken = [None, b"", b"junk", good[:-1], good[: fmt + 12], good[: fmt + 4] + b"\x04\0\0\0" + good[fmt + 8 :]]
    for at, value in ((8, 99), (10, 2), (12, 0), (22, 24)):  # format, channels, rate, bits
        broken.append(good[: fmt + at] + value.to_bytes(4 if at == 12 else 2, "little") + good[fmt + at + (4 if at == 12 else 2) :])
    clips = spark.createDataFrame([(i, m) for i, m in enumerate([*broken, good, media.wav(b"", media.ADPCM, block=36)])], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.media_features(clips, ("doc_id",)).collect()}
    assert all(tuple(got[i])[1:] == (None,) * 7 for i in range(len(broken)))
    assert got[len(broken)].payload_bytes == 200 and got[len(broken) + 1].feature.startswith("n=0;")
    eight = good[: fmt + 22] + b"\x08\0" + good[fmt + 24 :]
    assert media.samples([eight])[0][0].tolist() == [(v - 128) * 256 for v in range(200)]
    assert media.text_media(docs(spark, [])).count() == 0


# ---- op3


def test_warc(spark):
    pages = [(1, "u1", "same"), (2, None, "same"), (3, "u3", None), (4, "u4", ""), (5, "u\r\n5", "ä" * 100), (6, "u6", "same"), (None, "n", "other"), (7, "u7", "y" * 64), (2, None, "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archive = warc.write_archive(df, chunk_bytes=16)
    got = warc.read_archive(archive).collect()
    assert len(got) == len(pages) and all(r.intact for r in got)
    assert set(archive.columns) == {"record", "chunk_no", "n_chunks", "header", "data", "crc"}  # nothing beside the records to read from
    by = {r.page_id: r for r in got}
    import base64

    for i, _, h in pages:
        raw = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 6, None)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("revisit", 1), ("response", None)]
    assert max(len(r.data) for r in archive.collect()) <= 16
    flat = b"".join(warc.archive_bytes(r.asDict() for r in archive.orderBy("record", "chunk_no").toLocalIterator()))
    import gzip

    for raw in (flat, gzip.compress(flat[:50]) + gzip.compress(flat[50:])):
        records = {}
        for n, _, head, part in warc.parse_stream(io.BytesIO(raw), 7):
            records.setdefault(n, [head, b""])[1] += part
        assert sorted(body for head, body in records.values() if head["warc-type"] == "response") == sorted([b"same", b"", b"other", b"y" * 64, ("ä" * 100).encode()])
    body = flat.index("ä".encode())
    for cut in (flat.index(b"WARC-Type") + 5, flat.rindex(b"\r\n\r\n", 0, body) + 2, body + 5):
        with pytest.raises(EOFError):
            list(warc.parse_stream(io.BytesIO(flat[:cut])))
    for bad in (b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: -3\r\n\r\n", b"WARC/1.1\r\nX: " + b"y" * (2 << 20)):
        with pytest.raises(ValueError):
            list(warc.parse_stream(io.BytesIO(bad)))
    bomb = gzip.compress(b"WARC/1.1\r\nContent-Length: 30000000\r\n\r\n" + bytes(30_000_000))
    raw, parts = warc._Unzipped(io.BytesIO(bomb)), []
    while raw._more():
        parts.append(len(raw.out))
        raw.out = b""
    assert max(parts) <= 1 << 16 and sum(parts) > 30_000_000
    text = F.col("header").cast("string")

    def read(**columns):
        return {r.page_id: r for r in warc.read_archive(archive.withColumns(columns)).collect()}

    of5 = {r.record for r in archive.where(F.instr(text, "X-Page-Id: 5") > 0).collect()}
    broken = read(data=F.when(F.col("record").isin(of5) & (F.col("chunk_no") == 1), F.lit(b"0123456789abcdef")).otherwise(F.col("data")))
    assert [p for p, r in broken.items() if not r.intact] == [5]
    lost = warc.read_archive(archive.where(~(F.col("record").isin(of5) & (F.col("chunk_no") == 2)))).collect()
    assert [r.page_id for r in lost if not r.intact] == [5]
    # what a header says is what is read
    other = read(header=F.when(F.instr(text, "X-Page-Id: 7") > 0, F.regexp_replace(text, "X-Page-Id: 7", "X-Page-Id: 70").cast("binary")).otherwise(F.col("header")))
    assert other[70].intact and 7 not in other and other[70].payload_bytes == 64
    other = read(header=F.when(F.instr(text, "X-Page-Id: 7") > 0, F.regexp_replace(text, "sha1:.", "sha1:!").cast("binary")).otherwise(F.col("header")))
    assert [p for p, r in other.items() if not r.intact] == [7]
    other = read(header=F.when(F.instr(text, "X-Page-Id: 7") > 0, F.regexp_replace(text, "Content-Length", "Content").cast("binary")).otherwise(F.col("header")))
    assert 7 not in other and sum(r.record_type is None and not r.intact for r in other.values()) == 1
    many = spark.createDataFrame([(i, "u", "copy" if i % 3 else f"own {i}") for i in range(600)], "page_id long, url string, html string").withColumns({"sha": F.lit(1), "n": F.lit(2), "first": F.lit(3), "record": F.lit(4)})
    said = {r.page_id: r.refers_to for r in warc.round_trip(many).collect()}
    assert said == {i: 1 if i % 3 and i > 1 else None for i in range(600)}  # a large group, clashing columns
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(df.where("page_id is not null"), min_bytes=1000).collect()} == {"response"}


# ---- op4


def check_bins(hist, bins, cap=2048):
    held = {}
    for lengths, n in bins:
        assert sum(lengths) <= cap and n > 0
        for x in lengths:
            held[x] = held.get(x, 0) + n
    assert held == {k: v for k, v in hist.items() if v}
    return sum(n for _, n in bins)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20), st.integers(2, 6))
def test_plan_holds_everything(hist, groups):
    p = packing.PackParams(capacity=64, groups=(groups,))
    n = check_bins(hist, packing.plan(hist, p), 64)
    low = -(-sum(k * v for k, v in hist.items()) // 64)
    assert max(low, sum(v for k, v in hist.items() if k > 32)) <= n <= 2 * low + 1


def test_plan_of_uneven_lengths():
    assert check_bins({11: 12, 54: 1}, packing.plan({11: 12, 54: 1}, packing.PackParams(capacity=64, groups=(2,))), 64) == 4


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 50_000).astype(int) + 1)
    hist = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    n = check_bins(hist, packing.plan(hist))
    assert n <= 1.003 * -(-int(lengths.sum()) // 2048)
    third = {700: 3000, 683: 3000, 665: 3000}  # three to a bin
    assert check_bins(third, packing.plan(third)) <= 3060
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_packing_rows(spark):
    path = P.path("word_bpe_49k.json")
    df = odd(spark)
    got = packing.pack_documents(df, path, packing.PackParams(capacity=64, rows_per_salt=3)).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = []
    for r in df.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if pd.isna(x) else int(x) for x in r)
    assert sorted(map(key, want)) == sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    for _, b in got.sort_values("offset").groupby("sequence_id"):
        assert (b.offset.to_numpy() == np.concatenate([[0], np.cumsum(b.length)[:-1]])).all() and b.length.sum() <= 64
    assert packing.pack_documents(docs(spark, []), path).count() == 0
    withids = packing.pieces(docs(spark, ["a b"]), path, with_ids=True).first()
    assert withids.ids[-1] == 0 and len(withids.ids) == withids.length


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([*"aAzZ'sStTéÉßΣσİı０Ⅳ½́\x1c\x1e\x85\xa0​　\t\n  .,<|>中🎉", "<|startoftext|>", "<|endoftext|>"]), max_size=40).map("".join))
def test_word_tokenizer_is_exact(text):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing._tokenizer(path, 300_000).encode_batch([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_whole(spark, tmp_path):
    from tokenizers import Tokenizer

    from tessella.llm.queries import QUERIES

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, "hello <|endoftext|> world", "A<|startoftext|><|endoftext|>b", "don<|endoftext|>'t", "e<|endoftext|>\u0301x <|ENDOFTEXT|> <|endoftext|", "<|<|endoftext|>|>\n"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in QUERIES["op4_packing"](spark, str(tmp_path)).where("piece = 0").collect()}
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (min(2048, len(ids)), zlib.crc32(ids[:2048].tobytes()))


# ---- op5


def brute_components(fps, radius=2):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [2, 256])
def test_links_are_whole(spark, hot):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    for _ in range(150):  # a dense group, chains, and strangers
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            x ^= 1 << int(b)
        fps.add(x)
    x = 12345
    for b in range(40):
        x ^= 1 << b
        fps.add(x)
    fps |= {int(v) for v in rng.integers(0, 1 << 63, 50)}
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in fps]
    df = common.save(spark.createDataFrame([(v,) for v in signed], "fp long"), "t")
    got = {tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in simhash.links(df, hot).collect()}
    want = {(a, b) for i, b in enumerate(fps) for a in fps[:i] if (a ^ b).bit_count() <= 2}
    assert got == want
    roots = {r.node: r.root for r in connected_components(simhash.links(df, hot)).collect()}
    want = brute_components({v: v & (1 << 64) - 1 for v in signed})
    assert all(roots.get(v, v) == want[v] for v in signed)


def test_simhash_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    texts = [*ODD, text, text + " more", text.upper(), text]
    df = docs(spark, [*texts, text, None], [*range(len(texts)), None, None])
    got = simhash.near_duplicates(df).collect()
    want = brute_components({i: simhash.fingerprint(t) for i, t in enumerate(texts)})
    assert len(got) == len(texts) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sum(r.doc_id is None and r.component_id in (want[len(ODD)], want[0]) for r in got) == 2
    assert simhash.fingerprint("a\x0bb\x1cc d") == simhash.fingerprint("A b\x1cC\td")
    kept = [r.doc_id for r in simhash.representatives(df).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    h = spark.sql("select lower(hex(xxhash64('a b c'))) h").first().h
    assert int(h, 16) == __import__("xxhash").xxh64_intdigest(b"a b c", 42)


# ---- op6


def test_ann(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # a large group of equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (None, x[0].tolist(), 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    p = ann.AnnParams(sample_rows=700, leaf_rows=20, block_rows=60)
    got = ann.search(df, F.col("vec_id") % 20 == 0, p).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    y, found = x.astype(float), 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        s = np.round(y @ y[q], 12)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert len(g) == 20 and list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, y[g.vec_id] @ y[q], rtol=0, atol=1e-12)
        found += len(set(best) & set(g.vec_id))
    assert found / (20 * 75) >= 0.9
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0, p).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert ann.search(df.limit(0), F.col("vec_id") == 0, p).count() == 0


def test_ann_finds_k_in_thin_leaves(spark):
    rng = np.random.default_rng(3)
    groups = np.repeat(rng.normal(size=(40, 8)), 60, axis=0)
    x = np.concatenate([groups, 6 * rng.normal(size=(40, 8))]).astype(np.float32)
    rows = [(i * 20 if i >= len(groups) else i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, ann.AnnParams(sample_rows=2_500, leaf_rows=10, recall=0.5)).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {20} and len(got) == 120 + 40


@pytest.mark.parametrize("size", [1e-7, 1.0, 1e5])
def test_ann_recall_at_any_scale(spark, size):
    """Exact neighbours but for the leaves not opened; leaves follow the rows; clashing columns."""
    rng = np.random.default_rng(0)
    x = (size * rng.normal(size=(1_500, 8))).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2, [0.0]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, query_id long, v array<float>")
    p = ann.AnnParams(sample_rows=200, leaf_rows=40, leaf_most=60, block_rows=100)
    got = ann.search(df, F.col("vec_id") % 20 == 0, p).toPandas()
    y, hits = x.astype(float), 0
    for q in range(0, 1_500, 20):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        g = got[got.query_id == q].sort_values("rank")
        assert list(g.score) == sorted(g.score, reverse=True) and np.array_equal(g.score, s[g.vec_id])
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert hits / 1_500 >= 0.9


def test_ann_tree_grows(spark):
    x = np.random.default_rng(1).normal(size=(1_000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    p = ann.AnnParams(sample_rows=100, leaf_rows=50, leaf_most=30)
    first = ann.build_tree(x[:100], 40.0, p)
    tree = ann.grow(first, df, "array<double>", p)
    assert tree.leaves > first.leaves and sorted(tree.leaf[tree.leaf >= 0]) == list(range(tree.leaves))
    assert sorted(ann.best_bins(tree, x[0])) == list(range(tree.leaves))
    assert np.bincount(ann.leaf_of(tree, x), minlength=tree.leaves).max() <= 100
    assert ann.grow(first, df, "array<double>", ann.AnnParams(sample_rows=100, leaf_rows=50, leaf_most=30, max_leaves=first.leaves)).leaves == first.leaves


def test_ann_odd_vectors(spark):
    """Unequal lengths are searched apart; products that overflow are ranked by size."""
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0, 1.0]), (20, [2.0, 0.0, 1.0]), (4, []), (6, [1e200, 2e200, 0.0, 1.0]), (40, [3e200, 1e200, 0.0, 0.0]), (8, [2e200, 2e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    alone = ann.search(df.where(F.size("embedding") == 4), F.col("vec_id") % 20 == 0)
    assert alone.columns == found.columns and alone.count() == 2
    got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 11.0), (20, 1, 2, 3.0), (40, 1, 8, float("inf")), (40, 2, 6, float("inf"))]


# ---- op7


def test_langid(spark):
    rng = np.random.default_rng(1)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["str", "eng", "och", "vil"], "zz": ["ão", "ção", "lha", "nho"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(2, 5))) for _ in range(n))
    train = spark.createDataFrame([(i, say(k, 200), k) for i, k in enumerate([*parts] * 20)] + [(99, None, "xx"), (98, "text", None), (0, "again", "xx")], "doc_id long, text string, lang string")
    dicts = langid.fit(train)
    assert set(dicts) == set(parts)
    tests = [(1000 + i, say(k, n), k) for i, (k, n) in enumerate((k, n) for k in parts for n in (5, 60, 3000))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), dicts).collect()}
    assert all(got[i].lang_pred == k for i, _, k in tests) and all(0 <= r.score <= 1 and not r.rejected for r in got.values())
    strange = langid.identify(odd(spark), dicts).collect()
    assert len(strange) == len(ODD) + 3
    by = {r.doc_id: r for r in strange}
    assert [by[i].lang_pred for i in (0, 1, 2, 3, 9)] == ["und"] * 5 and by[0].rejected
    assert langid.fit(train.limit(0)) == {}
    assert all(r.lang_pred == "und" for r in langid.identify(odd(spark), {}).collect())
    said = langid.decide(["a", "b"], F.array(F.lit(10), F.lit(10)))
    assert tuple(spark.range(1).select(*[c.alias(k) for k, c in said.items()]).first()) == ("a", 0.5, True, 0.0)
    assert langid.identify(docs(spark, []), dicts).count() == 0


@pytest.mark.parametrize("group", [1, 2, 256])
def test_langid_sizes_are_those_of_the_library(spark, group):
    """Every block of every text with plain zstandard, and languages in one group or several."""
    import zstandard

    p = langid.LangIdParams(group=group, dict_bytes=600)
    rng = np.random.default_rng(8)
    say = lambda s, n: " ".join("".join(rng.choice([*s], rng.integers(1, 7))) for _ in range(n))
    train = spark.createDataFrame([(i, say("abcd" if i % 3 else "wxyzé", 30), "l%d" % min(2, i % 4)) for i in range(40)], "doc_id long, text string, lang string")
    dicts = langid.fit(train, p)
    assert len(dicts) == 3
    texts = ["", "a", say("abcd", 49), say("abcd", 50), say("wxyzé", 900), say("aw", 3), "ÀÉ! 12 b"]
    got = {r.doc_id: r for r in langid.identify(docs(spark, texts), dicts, p).collect()}
    for i, t in enumerate(texts):
        s = re.sub(r"[\W\d_]+", " ", t.lower()).strip()
        sizes = []
        for content in dicts.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=p.level)
            primer = content[len(content) // 16 : len(content) // 16 + 256] + b" "
            size = lambda b: len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
            sizes.append(sum(size(primer + s[k : k + 1024].encode()) - size(primer) for k in range(0, len(s), 1024)))
        if not s:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        best, second = sorted(sizes)[:2]
        assert got[i].lang_pred == [*dicts][sizes.index(best)] and got[i].margin == second - best
        assert got[i].score == pytest.approx(1 / sum(2 ** -min(500, (x - best) / 4) for x in sizes))
        assert got[i].rejected == (second - best < max(1.0, 0.02 * best))


# ---- op8


def brute_lines(texts, least):
    """Text of each document without later copies of runs of at least ``least`` words: all runs by plain comparison."""
    full = [[(n, x) for n, x in enumerate((t or "").split("\n")) if re.search(r"\S", x)] for t in texts]
    words = lambda x: len(re.findall(r"\S+", x))
    seen, out = set(), []
    for d, lines in enumerate(full):
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(map(words, run)) >= least:
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(run)
        keep, own = [], (texts[d] or "").split("\n")
        marks = sorted(gone)
        spans, k = [], 0
        while k < len(marks):
            j = k
            while j + 1 < len(marks) and marks[j + 1] == marks[j] + 1:
                j += 1
            spans.append((lines[marks[k]][0], lines[marks[j]][0]))
            k = j + 1
        keep = [x for n, x in enumerate(own) if not any(lo <= n <= hi for lo, hi in spans)]
        out.append("\n".join(keep) if spans else texts[d])
    return out


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup(spark, least):
    rng = np.random.default_rng(least)
    pool = ["a b c", "d", "e f", "g h i j k", "", "  ", "l m n"]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 14))) for _ in range(40)] + [None, "", "\n"]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts), least).collect()}
    want = brute_lines(texts, least)
    assert [got[i].text for i in range(len(texts))] == want
    assert got[40].text is None and got[40].n_lines == 1 and got[40].n_removed == 0


def test_line_dedup_odd(spark):
    passage = " ".join(["w"] * 60)
    df = docs(spark, [f"first\n{passage}\nlast", f"other\n{passage}\nend", f"other\n{passage}\nend", passage, None], [3, 4, 4, None, None])
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted([(3, f"first\n{passage}\nlast"), (4, "other\nend"), (4, "other\nend"), (None, ""), (None, None)], key=str)
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    assert linededup.dedup_lines(odd(spark)).count() == len(ODD) + 3


# ---- op9


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    clean = [f"{a}{b}" for a in ("bar", "lin", "mor", "tes", "vol") for b in ("ak", "en", "ol", "ut", "iss")]
    rows = []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        if i % 4 == 0:
            w[5:8] = rng.choice(["gruzzlef", "snarkbag", "flonkhead"], 3)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    p = toxicity.ToxicityParams(toxic_rows=100, clean_rows=300, buckets=1 << 14)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), p)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows]) > 0.98
    f = lambda t: toxicity.scores([t], model)[0]
    base = " ".join(clean)
    assert f(base + " gruzzlefs snarkbags flonkheads") > f(base) + 0.3  # never seen, shared n-grams
    strange = toxicity.score(odd(spark), model).collect()
    assert len(strange) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in strange)
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = toxicity.fit(df.limit(0).select("doc_id", "text"), df.select("doc_id", "toxic"), p)
    assert 0 <= toxicity.scores(["text"], none)[0] <= 1
    assert toxicity.scores(["a"], toxicity.train(["a", "b"], np.array([1, 1]), p))[0] > 0.9


def plain_buckets(word, p):
    """Buckets of a word and of its n-grams, one by one."""
    full = (1 << 64) - 1
    mul = 0x9E3779B97F4A7C15

    def mixed(h):
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & full
        return h ^ h >> 32

    def poly(values):
        return sum(v * pow(mul, i + 1, 1 << 64) for i, v in enumerate(values)) & full

    marked = [1, *(ord(c) + 3 for c in word), 2]
    out = [mixed(mixed(poly([ord(c) + 1 for c in word])) ^ 77) % p.buckets]
    for n in range(p.n_min, p.n_max + 1):
        out += [mixed(poly(marked[i : i + n]) * (2 * n + 1) & full) % p.buckets for i in range(len(marked) - n + 1)]
    return out


def plain_score(text, model):
    """The score by plain Python."""
    p, counts, word = model.params, {}, ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            counts[word] = counts.get(word, 0) + 1
            word = ""
    total, share = 0.0, sum(n**0.5 for n in counts.values()) + p.zeros
    for w, n in counts.items():
        b = plain_buckets(w, p)
        total += n**0.5 / share * float(np.mean(model.weight[b].astype(float)))
    return 1 / (1 + np.exp(-(total + model.bias)))


def test_toxicity_scores_whole_texts(monkeypatch):
    p = toxicity.ToxicityParams(buckets=1 << 12)
    rng = np.random.default_rng(9)
    model = toxicity.ToxicityModel(rng.normal(0, 20, p.buckets).astype(np.float32), -1.0, p)
    long_run = "".join(chr(0x4E00 + i * 7 % 900) for i in range(6_000)) + "🎉毒毒"
    texts = [*(t or "" for t in ODD), "ab" * 60 + "gruzzlef", long_run, "It's the İstanbul ſ ﬁ x_y 12 a\u0301", "one two two three three three"]
    want = [plain_score(t, model) for t in texts]
    assert np.allclose(toxicity.scores(texts, model), want, atol=1e-8)
    monkeypatch.setattr(toxicity, "BLOCK", 50)  # in whatever blocks, whatever stands beside
    assert np.allclose(toxicity.scores(texts[::-1], model)[::-1], want, atol=1e-8)
    assert toxicity.scores([], model).tolist() == []


def test_toxicity_trains_what_stands_out():
    """The noise of every bucket, against a plain sum over texts; weights stay zero below the bound."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "vile"] if i % 3 else ["lorem", "ipsum", "dolor", "amet"], 6)) for i in range(60)]
    y = np.array([float("vile" in t) for t in texts])
    p = toxicity.ToxicityParams(buckets=1 << 10)
    sample = toxicity._Sample(texts, y, p)
    part = sample.rows(np.arange(60))
    weight = part.weights(p)
    phi = np.zeros((60, p.buckets))
    for i, t in enumerate(texts):
        own = {w: t.split().count(w) ** 0.5 for w in t.split()}
        for w, n in own.items():
            b = plain_buckets(w, p)
            for g in b:
                phi[i, g] += n / (sum(own.values()) + p.zeros) / len(b)
    delta = (p.toxic_weight - y) * weight
    want = np.abs(delta @ phi) / np.sqrt(delta**2 @ phi**2 + 1e-300)
    assert np.allclose(part.noise(p), want[sample.used])
    model = toxicity.train(texts, y, p)
    assert not model.weight[[g for g in range(p.buckets) if g not in set(sample.used[part.noise(p) >= model.noise])]].any()
    assert all((s >= 0.5) == (l > 0) for s, l in zip(toxicity.scores(texts, model), y, strict=True))


# ---- op10

PAGES = {
    "<html><body><nav><a href=/>Home</a> <a href=/x>More</a></nav><article><h1>Title &amp; so</h1><p>One <b>two</b>\n three<br>four.<p>Five &lt;six&gt; &eacute;&#33;</article><footer>&copy; me</footer></body></html>": "Title & so\nOne two three four.\nFive <six> é!",
    "<body><div class='ad banner'>Buy this now</div><article><p>Text one.</p><aside>Also read</aside><p>Text two.</p></article><div id=comments><p>Nice article, I liked it very much indeed</p></div>": "Text one.\nText two.",
    "<script>var a='<p>no</p>';</script><style>p{}</style><article><p>yes indeed</p><form>Name <input></form><!-- <p>gone</p> --></article>": "yes indeed",
    "<article><div class='post-header'><h1>Head</h1></div><p>Body text here.</p><div class=ad>Buy twenty of these very good things now and save a lot of money on every one of them</div><div class=related><a href=/q>Other</a></div><p>Tail.</p></article>": "Head\nBody text here.\nTail.",
    "": "",
    "<nav>only a menu</nav>": "",
    "<article><p>unclosed <i>text": "unclosed text",
}


def test_html(spark):
    assert [htmltext.main_text(h) for h in PAGES] == list(PAGES.values())
    assert htmltext.main_text(None) == ""
    deep = "<div>" * 3_000 + "<p>deep</p>"
    assert htmltext.main_text("<article>" + deep + "</article>") == "deep"
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate([*PAGES, None])], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert len(got) == len(PAGES) + 1 and all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 9), st.sampled_from([1.0, 4.0]), st.randoms(use_true_random=False))
def test_min_cut_is_minimal(n, weight, r):
    prose, junk = ([r.randint(0, 9) * 1.0 for _ in range(n)] for _ in range(2))
    links = [(i, j, r.randint(0, 5) * weight) for i in range(n) for j in range(i) if r.random() < 0.5]

    def cost(keep):
        return sum(junk[i] if k else prose[i] for i, k in enumerate(keep)) + sum(c for i, j, c in links if keep[i] != keep[j])

    every = [[bool(m >> i & 1) for i in range(n)] for m in range(1 << n)]
    best = min(map(cost, every))
    got = htmltext.min_cut(prose, junk, links)
    assert cost(got) == pytest.approx(best)
    assert sum(got) == min(sum(k) for k in every if cost(k) < best + 1e-6)


def plain_main_text(page):
    """The whole extraction by the standard library's parser and all cuts of up to 14 blocks."""
    from html.parser import HTMLParser

    w = htmltext.WEIGHTS
    names = {"ad", "menu", "comments", "cookie", "sidebar"}
    never = {"nav", "footer", "aside", "form", "head"}
    flow = {"div", "p", "article", "section", "h1", "ul", "li", "nav", "footer", "aside", "form", "body", "html", "head", "main", "td", "tr", "table"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack = [("html", 0, 0, 0, None)]  # tag, depth, bad, good, parent's place in self.nodes
            self.nodes, self.path, self.blocks, self.held, self.skip, self.link = [("html", -1, 0, 0)], [0], [], "", 0, 0
            self.linked = 0

        def flush(self):
            text = " ".join(self.held.split())
            if text:
                self.blocks.append((text, self.own, self.linked))
            self.held, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            if tag == "br":
                self.held += " "
            if tag == "a":
                self.link += 1
            if tag in flow and tag not in ("html", "body"):
                self.flush()
                _, _, bad, good = self.nodes[self.path[-1]]
                if tag in never:
                    bad = htmltext.NEVER
                elif tag in ("article", "main"):
                    good = 1.0
                cls = dict(attrs).get("class", "")
                if cls in names:
                    bad = max(bad, w["bad"])
                elif cls == "social":
                    bad = max(bad, w["weak"])
                self.nodes.append((tag, self.path[-1], bad, good))
                self.path.append(len(self.nodes) - 1)

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip -= 1
            if tag == "a":
                self.link -= 1
            if tag in flow and tag not in ("html", "body"):
                self.flush()
                self.path.pop()

        def handle_data(self, data):
            if not self.skip:
                if not self.held:
                    self.own = self.path[-1]
                self.held += data
                if self.link:
                    self.linked += len(data.strip())

    r = Reader()
    r.feed(page)
    r.close()
    r.flush()
    cost = []
    for text, own, linked in r.blocks:
        tag, _, bad, good = r.nodes[own]
        share = min(1.0, linked / len(text))
        cost.append((w["prose"] + w["word"] * np.log1p(len(re.findall(r"\w+", text))) * (1 - share) + w["good"] * good + w["text"] * (tag in ("h1", "p")), w["junk"] + w["link"] * share + bad + w["item"] * (tag in ("li", "td"))))

    def up(i):
        out = [i]
        while r.nodes[i][1] >= 0:
            i = r.nodes[i][1]
            out.append(i)
        return out

    links, last = [], {}
    for k, (_, own, _) in enumerate(r.blocks):
        if k:
            a, b = up(r.blocks[k - 1][1]), up(own)
            common = len(set(a) & set(b))
            links.append((k - 1, k, 1.2 / (1 + len(a) + len(b) - 2 * common)))
        parent = r.nodes[own][1]
        if parent in last and last[parent] != k - 1:
            links.append((last[parent], k, 0.4))
        last[parent] = k

    def total(keep):
        return sum(c[1] if k else c[0] for c, k in zip(cost, keep, strict=True)) + sum(c for i, j, c in links if keep[i] != keep[j])

    every = ([bool(m >> i & 1) for i in range(len(cost))] for m in range(1 << len(cost)))
    keep = min(every, key=lambda k: (round(total(k), 9), sum(k)))
    return "\n".join(t for (t, _, _), k in zip(r.blocks, keep, strict=True) if k)


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_html_is_the_plain_extraction(r):
    words = ["one", "two", "three", "&amp;", "four", "caf&eacute;"]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    def part(depth, room):
        kind = r.choice(["p", "p", "h1", "div", "section", "ul", "nav", "article", "aside", "form", "script"])
        if kind == "script":
            return "<script>var a = 1 < 2;</script>"
        cls = r.choice(["", "", "", " class='ad'", " class='comments'", " class='social'", " class='sidebar'"]) if kind in ("div", "section") else ""
        if kind in ("p", "h1"):
            inner = r.choice([text(r.randint(1, 40)), f"<a href='/x'>{text(2)}</a> {text(r.randint(0, 3))}", f"{text(3)}<br><b>{text(2)}</b>"])
        elif kind == "ul":
            inner = "".join(f"<li><a href=/>{text(1)}</a></li>" for _ in range(r.randint(1, 2)))
        else:
            inner = "".join(part(depth + 1, room) for _ in range(r.randint(1, 2))) if depth < 3 else f"<p>{text(5)}</p>"
        return f"<{kind}{cls}>{inner}</{kind}>"

    page = "<html><body>" + "".join(part(0, 0) for _ in range(r.randint(1, 3))) + "</body></html>"
    if len(htmltext.blocks(page)) <= 11:
        assert htmltext.main_text(page) == plain_main_text(page)


def test_html_long_pages(spark):
    import time

    prose = " ".join(["word"] * 25)
    for cls in ("social", "legal"):
        for page in (f"<body><div class={cls}><p>{prose}</p></div></body>", f"<article><p>Start here now.</p><div class={cls}><p>{prose * 40}</p></div></article>"):
            assert prose in htmltext.main_text(page)
        assert htmltext.main_text(f"<body><article><p>{prose}</p></article><div class={cls}>Share this</div></body>") == prose
    assert "word" not in htmltext.main_text(f"<article><p>Text.</p><div class='comments'><p>{prose * 100}</p></div></article>")
    for page in ("<p>w</p>" * 16_000, "<li><a href=/>x</a> y</li>" * 16_000, "".join(f"<div><p>some text {i}</p><ul><li><a href=/>l</a></li></ul></div>" for i in range(8_000))):
        start = time.process_time()
        htmltext.main_text(f"<body>{page}</body>")
        assert time.process_time() - start < 10
    whole = "<article>" + "".join(f"<p>{prose} {i}</p>" for i in range(3_000)) + "</article>"
    assert htmltext.main_text(whole).count("\n") == 2_999
    long_block = "x y " * 3_000
    assert htmltext.main_text(f"<article><p>{long_block}</p></article>") == long_block.strip()
    same = spark.createDataFrame([(1, "u", whole)] * 2, "page_id long, url string, html string")
    assert len({r.text for r in htmltext.extract(same).collect()}) == 1 and htmltext.extract(same).count() == 2


# ---- near-duplicates of the pipeline


def test_similar_texts_link(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5_000, n)]
    texts = [*ODD]
    for n in (60, 200, 800):
        for share in (0.01, 0.02, 0.03, 0.06):
            for _ in range(4):
                base = words(n)
                texts.append(" ".join(base))
                for k in rng.choice(n, max(1, int(n * share)), replace=False):
                    base[k] = "other"
                texts.append(" ".join(base))
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    like = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0
    near = [(i, j) for j in range(len(texts)) for i in range(j) if like(sets[i], sets[j])]
    fps = [simhash.fingerprint(t) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 for i, j in near) > 10  # op5 does not link these
    p = similar.SimilarParams()
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts), similar=p).collect()}
    assert all(got[i] == got[j] for i, j in near)
    apart = [(i, i + 1) for i in range(len(ODD), len(texts), 2) if (i, i + 1) not in near and (fps[i] ^ fps[i + 1]).bit_count() > 2]
    assert apart and all(got[i] != got[j] for i, j in apart)
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()} == set(got.values())
    assert simhash.near_duplicates(docs(spark, []), similar=p).count() == 0


def join_rows(spark, call):
    """Most rows that one join of what ``call`` runs made."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    before = store.executionsCount()
    call()
    runs = store.executionsList()
    for k in range(before, runs.size()):
        at = runs.apply(k).executionId()
        seen, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for m in range(metrics.size() if "Join" in nodes.apply(n).name() else 0):
                if metrics.apply(m).name() == "number of output rows":
                    most = max(most, int(seen.apply(metrics.apply(m).accumulatorId()).replace(",", "")))
    return most


def test_near_copies_meet_few(spark):
    """Copies of one text with words of their own, most of them under the similarity: no join grows with their square."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5_000, 150)]
    texts = [" ".join(base)]
    for i in range(500):
        one = list(base)
        for k in rng.choice(150, rng.integers(2, 8), replace=False):
            one[k] = f"own{i}n{k}"
        texts.append(" ".join(one[: 150 - int(rng.integers(0, 3))]))
    p, got = similar.SimilarParams(), {}
    most = join_rows(spark, lambda: got.update({r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts), similar=p).collect()}))
    assert len(texts) < most < p.entries * len(texts)  # as many as they have entries
    sets, fps = [set(simhash.shingles(t, p.words).tolist()) for t in texts], [simhash.fingerprint(t) for t in texts]
    root = [*range(len(texts))]
    for j in root:
        for i in range(j):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) or (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)


def test_rarest_shingles_meet(spark):
    """Every similar pair of sets of different roots is among the pairs compared, at 0.8 exactly too, whatever the sizes."""
    rng, p = np.random.default_rng(8), similar.SimilarParams()
    sets = [{1}, {2}, {1, 2}, set(range(100, 104)), set(range(100, 105)), set(range(200, 209)), set(range(201, 210)), {-5, *range(200, 209)}]
    for n in (3, 6, 10, 30, 120, 400):
        for _ in range(12):
            one = set(rng.integers(-n * 3, n * 3, n).tolist())
            sets += [one, {*rng.permutation([*one])[: max(1, int(len(one) * rng.uniform(0.75, 1)))].tolist()}, {*one, *rng.integers(10**6, 10**9, int(n * rng.uniform(0, 0.3))).tolist()}]
            sets.append({*rng.permutation([*sets[-1]])[: max(1, int(len(sets[-1]) * 0.95))].tolist()})
    sets = [set(x) for x in {frozenset(map(int, x)) for x in sets}]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(near) > 100 and any(5 * len(sets[i] & sets[j]) == 4 * len(sets[i] | sets[j]) for i, j in near)
    posts = common.save(similar.postings(spark.createDataFrame([(i, [*map(int, x)]) for i, x in enumerate(sets)], "s long, h array<long>"), p), "test-postings")
    for groups in (len(sets), 7):
        root = {i: i % groups for i in range(len(sets))}
        left = spark.createDataFrame([*root.items()], "s long, root long")
        got = {(r.a, r.b) for r in similar.rest_pairs(posts, left, p).collect()}
        assert {x for x in near if root[x[0]] != root[x[1]]} <= got and all(root[a] != root[b] for a, b in got)
        assert len(got) < len(sets) ** 2 / 8
        lead = {(r.a, r.b) for turn in (0, 1) for r in similar.lead_pairs(posts, left, turn, p).collect()}
        assert lead and lead <= got


# ---- what all share


def test_ids_must_be_whole(spark):
    named = spark.createDataFrame([("a", "text", "en", "s", 4)], "doc_id string, text string, lang string, source string, n_chars long")
    for f in (simhash.near_duplicates, linededup.dedup_lines):
        with pytest.raises(TypeError):
            f(named)


def test_saved_tables_go(spark):
    import os

    df = common.save(spark.range(3), "gone")
    path = df._saved_at.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    common.drop_saved(df)
    assert not os.path.exists(path)


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
