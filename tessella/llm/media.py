"""Telephony audio in binary columns.

mu-law and A-law samples expand by lookup tables, IMA ADPCM blocks decode with
numpy over all blocks of many clips at once, and resampled 16-bit PCM is stored
as WAV.  A clip is RIFF/WAVE bytes with format 1 (PCM), 6 (A-law), 7 (mu-law) or
17 (IMA ADPCM), one channel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, release, save, text_of

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE = 8_000
UNIT = 192
PAD = b" "
#: Rate of the PCM that is stored beside the texts' clips: at the clips' own rate it would take four to eight times their bytes.
STORED_RATE = 1_000
#: ADPCM blocks that are decoded at once.
BLOCKS = 8_192

# Fixed values of the IMA ADPCM format: index steps by code.
_INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _step_sizes() -> np.ndarray:
    """The 89 quantiser steps of IMA ADPCM: each about a tenth above the last."""
    # Fixed values of the IMA ADPCM format.
    first = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(first, np.int32)


_STEP = _step_sizes()


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    part, exp = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(exp == 0, part + 8, (part + 0x108) << np.maximum(exp - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(data: bytes, kind: int = PCM, rate: int = RATE, block: int | None = None) -> bytes:
    """A one-channel WAV file around ``data``, stored as it is."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, ADPCM: 4}[kind]
    align = block or bits // 8
    if kind == ADPCM:
        per = (align - 4) * 2 + 1
        fmt = struct.pack("<HHIIHHHH", kind, 1, rate, rate * align // per, align, bits, 2, per)
    else:
        fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * align, align, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format, rate, block size and stored bytes of a WAV file.

    ValueError if it is none, is cut, or is of a form that :func:`samples` doesn't know.
    """
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, head = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if at + 8 + size > len(view):
            break
        if name == b"fmt ":
            if size < 16:
                raise ValueError("the format is cut")
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if channels != 1 or not rate:
                raise ValueError("one channel and a rate are asked for")
            if bits not in {PCM: (8, 16), ALAW: (8,), MULAW: (8,), ADPCM: (4,)}.get(kind, ()) or kind == ADPCM and align < 5:
                raise ValueError(f"format {kind} of {bits} bits is not known")
            head = kind, rate, bits if kind == PCM else align
        elif name == b"data":
            if head is None:
                break
            return *head, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no complete data chunk")


def _adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of whole blocks, a row each: one numpy step decodes a sample of every block."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.stack([blocks[:, 4:] & 0x0F, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((codes.shape[1] + 1, len(blocks)), np.int16)
    out[0] = value
    for t, code in enumerate(np.ascontiguousarray(codes.T)):
        step = _STEP[index]
        diff = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + _INDEX_STEP[code], 0, 88)
        out[t + 1] = value
    return out.T


def decode_adpcm(clips: list[bytes | memoryview], block: int) -> list[np.ndarray]:
    """IMA ADPCM clips of one block size to 16-bit samples, at most BLOCKS blocks of any clips at once.

    A last block that is short decodes as far as it goes.
    """
    if block < 5:
        raise ValueError("a block has a header of 4 bytes and data")
    per = 2 * (block - 4) + 1
    count = [-(-len(c) // block) for c in clips]
    raw = np.zeros((sum(count), block), np.uint8)
    at = 0
    for c, n in zip(clips, count, strict=True):
        raw[at : at + n].reshape(-1)[: len(c)] = np.frombuffer(c, np.uint8)
        at += n
    pcm = np.empty((len(raw), per), np.int16)
    for k in range(0, len(raw), BLOCKS):
        pcm[k : k + BLOCKS] = _adpcm(raw[k : k + BLOCKS])
    out, at = [], 0
    for c, n in zip(clips, count, strict=True):
        short = len(c) - max(0, n - 1) * block
        last = 2 * (short - 4) + 1 if short >= 4 else 0
        out.append(pcm[at : at + n].reshape(-1)[: max(0, n - 1) * per + last])
        at += n
    return out


def samples(clips: list[bytes | None]) -> list[tuple[np.ndarray, int, memoryview] | None]:
    """16-bit samples, rate and stored bytes of clips in any of the formats; None for one that is null or broken."""
    out: list = [None] * len(clips)
    packed: dict[int, list[int]] = {}
    for i, m in enumerate(clips):
        try:
            kind, rate, align, data = parse(m or b"")
        except ValueError:
            continue
        if kind == ADPCM:
            packed.setdefault(align, []).append(i)
            x = None
        elif kind in _TABLES:
            x = _TABLES[kind][np.frombuffer(data, np.uint8)]
        elif align == 8:
            x = (np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8
        else:
            x = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        out[i] = (x, rate, data)
    for align, rows in packed.items():
        for i, x in zip(rows, decode_adpcm([out[i][2] for i in rows], align), strict=True):
            out[i] = (x, *out[i][1:])
    return out


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """In whole numbers, so that every machine gives the same samples: upwards by linear interpolation, downwards by the mean of each new sample's span."""
    if rate == to or not len(x):
        return x.astype(np.int16)
    if to < rate:
        first = np.arange(max(1, len(x) * to // rate), dtype=np.int64) * rate // to
        count = np.diff(np.append(first, min(len(x), len(first) * rate // to)))
        total = np.add.reduceat(x[: first[-1] + count[-1]].astype(np.int64), first)
        return (total // np.maximum(count, 1)).astype(np.int16)
    pos = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    at, part = np.divmod(pos, to)
    after = np.minimum(at + 1, len(x) - 1)
    a, b = x[at].astype(np.int64), x[after].astype(np.int64)
    return ((a * (to - part) + b * part) // to).astype(np.int16)


def feature(pcm: np.ndarray, rate: int) -> str:
    """samples, rate, energy, peak and zero crossings, all whole numbers, and the PCM's CRC-32."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return f"n={len(x)};rate={rate};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with blanks up to a positive multiple of UNIT, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def clip_of(payload: bytes) -> bytes:
    """The payload as the stored bytes of a mu-law, A-law or ADPCM clip, by its CRC-32: equal payloads, equal clips."""
    kind = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
    return wav(payload, kind, block=UNIT if kind == ADPCM else None)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's payload as a clip, whose samples or blocks are its bytes."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [payload_of(t) for t in b.pop("text")]
            yield b.assign(n_bytes=np.array([n for _, n in both], np.int64), media=[clip_of(p) for p, _ in both])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def media_features(clips: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), rate: int = STORED_RATE) -> DataFrame:
    """Digests of each stored clip, features of its samples, and ``pcm``: 16-bit PCM WAV at ``rate``.

    A null or broken clip gives nulls; an empty one has no samples.
    """
    bounded(clips.sparkSession)
    names = ", ".join(f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in keep)

    def one(m: bytes, said: tuple | None) -> tuple:
        if said is None:
            return (None,) * 7
        x, own, data = said
        pcm = wav(resample(x, own, rate).astype("<i2").tobytes(), PCM, rate)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(x, own), pcm

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
        for b in batches:
            media = b.pop("media").tolist()
            out = pd.DataFrame([one(m, x) for m, x in zip(media, samples(media), strict=True)], columns=cols, index=b.index, dtype=object)
            for c in ("payload_bytes", "tail_crc32", "media_bytes"):
                out[c] = out[c].astype("Int64")
            yield pd.concat([b, out], axis=1)
        release()

    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return clips.select(*keep, "media").mapInPandas(run, f"{names}, {kinds}")


def to_pcm(clips: DataFrame, keep: tuple[str, ...] = ("doc_id",), rate: int = RATE * 2) -> DataFrame:
    """``keep`` columns with ``media`` as 16-bit PCM WAV at ``rate``; null where a clip is null or broken."""
    return media_features(clips, keep, rate).select(*keep, F.col("pcm").alias("media"))


def text_media(docs: DataFrame, rate: int = STORED_RATE) -> DataFrame:
    """Store every text as a clip in a table in the shared folder, read it back, describe it and store its PCM.

    pcm_bytes and pcm_sha256 are of the stored PCM, read back.
    """
    clips = save(store_texts(docs), "media", "zstd")
    told = save(media_features(clips, rate=rate), "media-pcm", "zstd")
    return told.select(*[c for c in told.columns if c != "pcm"], F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))
