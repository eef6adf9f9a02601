"""Telephony audio columns: G.711 by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM, WAV bytes.

Contract of `media_features`: one row per input row. A null text is an empty payload (padded to one unit); an empty
table gives no rows; repeated rows repeat; equal texts give equal values; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import chunks, two, utf8

UNIT, PAD, RATE = 576, 255, 8000
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
BLOCK = 36  # bytes of an ADPCM block: 4 of header, 64 samples of 4 bits

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = ((((code & 15).astype(np.int32) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    part, low = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()


def decode_adpcm(raw: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, BLOCK) of uint8 -> (n, 65) int16; each of the 64 steps runs over all blocks at once."""
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out = np.empty((raw.shape[1] * 2 - 7, len(raw)), np.int16)
    out[0] = value
    for k in range(out.shape[0] - 1):
        code = (raw[:, 4 + k // 2] >> (4 * (k % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def doubled(pcm: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; `last` marks places after which another recording begins."""
    following = np.empty_like(pcm)
    following[:-1] = pcm[1:]
    following[last] = pcm[last]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + following) >> 1
    return out


def to_wav(payload: bytes, kind: int = MULAW, rate: int = RATE) -> bytes:
    """A RIFF file around the samples as they are."""
    width, align = (2, 2) if kind == PCM else (1, 1) if kind in (ALAW, MULAW) else (0, BLOCK)
    extra = struct.pack("<HH", 2, 2 * BLOCK - 7) if kind == ADPCM else struct.pack("<H", 0)
    per_second = rate * align if width else rate * BLOCK // (2 * BLOCK - 7)
    form = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, 8 * width or 4) + extra
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def from_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format, rate and samples of a RIFF file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def to_pcm(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a telephony file."""
    kind, rate, raw = from_wav(media)
    codes = np.frombuffer(raw, np.uint8)
    if kind == MULAW:
        return rate, MULAW_TABLE[codes]
    if kind == ALAW:
        return rate, ALAW_TABLE[codes]
    if kind == ADPCM:
        return rate, decode_adpcm(codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    if kind == PCM:
        return rate, np.frombuffer(raw, "<i2")
    raise ValueError(f"format {kind}")


def resampled_wav(media: bytes) -> bytes:
    """The PCM file at twice the rate that a pipeline stores."""
    rate, pcm = to_pcm(media)
    return to_wav(doubled(pcm, np.array([len(pcm) - 1])).tobytes() if len(pcm) else b"", PCM, 2 * rate)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw, at = utf8(batch.column("text"))
        stored, found = [], {k: [] for k in ("n", "p", "ps", "tail", "m", "ms")}
        for b, e in zip(at[:-1].tolist(), at[1:].tolist()):
            n = e - b
            size = max(1, -(-n // UNIT)) * UNIT
            media = to_wav(raw[b:e].tobytes() + bytes([PAD]) * (size - n))
            payload = from_wav(media)[2]
            stored.append(payload)
            for k, v in zip(found, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())):
                found[k].append(v)
        codes = np.frombuffer(b"".join(stored), np.uint8)
        ends = np.cumsum(found["p"])
        begins = ends - found["p"]
        pcm = MULAW_TABLE[codes]
        wide = doubled(pcm, ends - 1).view(np.uint8)
        energy = np.add.reduceat(pcm.astype(np.int64) ** 2, begins)
        other = np.add.reduceat(np.abs(ALAW_TABLE[codes].astype(np.int64)), begins)
        turns = np.zeros(len(pcm), np.int64)
        turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
        turns[begins] = 0
        crossings = np.add.reduceat(turns, begins)
        blocks = decode_adpcm(codes.reshape(-1, BLOCK))
        peak = np.maximum.reduceat(np.abs(blocks.astype(np.int32)).max(axis=1), begins // BLOCK)
        feature = [
            f"rms={(energy[i] / found['p'][i]) ** 0.5:.3f};crossings={crossings[i]};alaw_mean={other[i] / found['p'][i]:.3f};adpcm_peak={peak[i]};pcm16k_crc={zlib.crc32(wide[4 * begins[i] : 4 * ends[i]]):08x}"
            for i in range(len(stored))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(found[k], pa.int64()) for k in ("n", "p")), pa.array(found["ps"]), pa.array(found["tail"], pa.int64()), pa.array(found["m"], pa.int64()), pa.array(found["ms"]), pa.array(feature)],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_features(docs: DataFrame) -> DataFrame:
    """Every text as a mu-law recording: stored, read back, decoded and resampled; its digest and features."""
    return two(docs).mapInArrow(_features, FEATURES)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw, at = utf8(batch.column("text"))
        media = [to_wav(raw[b:e].tobytes() + bytes([PAD]) * (max(1, -(-(e - b) // UNIT)) * UNIT - (e - b))) for b, e in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary()), pa.array([resampled_wav(m) for m in media], pa.binary())], ["doc_id", "media", "pcm"])


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, the mu-law file and its resampled PCM file."""
    return two(docs).mapInArrow(_media, "doc_id long, media binary, pcm binary")
