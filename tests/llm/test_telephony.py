import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.brute import awkward, by_id, fixture
from tessera.llm import telephony as t


def mulaw(code):
    code = ~code & 255
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return (-1 if code & 128 else 1) * size * 4


def alaw(code):
    code ^= 0x55
    part, low = code >> 4 & 7, code & 15
    size = 2 * low + 1 if not part else (2 * low + 33) << (part - 1)
    return (1 if code & 128 else -1) * size * 8


def adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.CHANGES[code & 7])))
            out.append(value)
    return out


def test_tables():
    assert t.MULAW_TABLE.tolist() == [mulaw(c) for c in range(256)]
    assert t.ALAW_TABLE.tolist() == [alaw(c) for c in range(256)]
    assert mulaw(0) == -32124 and mulaw(255) == 0 and alaw(0xD5) == 8


def test_adpcm_across_blocks():
    raw = np.random.default_rng(5).integers(0, 256, (50, t.BLOCK), dtype=np.uint8)
    assert t.decode_adpcm(raw).tolist() == [adpcm(b.tobytes()) for b in raw]


def test_files():
    raw = bytes(range(256)) * 9
    for kind in (t.PCM, t.ALAW, t.MULAW, t.ADPCM):
        assert t.from_wav(t.to_wav(raw, kind)) == (kind, t.RATE, raw)
    rate, pcm = t.to_pcm(t.resampled_wav(t.to_wav(raw)))
    assert rate == 2 * t.RATE and len(pcm) == 2 * len(raw)
    assert pcm[::2].tolist() == [mulaw(c) for c in raw]
    assert t.from_wav(t.resampled_wav(t.to_wav(b"")))[2] == b""
    for bad in (b"", b"RIFF0000WAVE", t.to_wav(raw, 99)):
        with pytest.raises(ValueError):
            t.to_pcm(bad)


def test_awkward_rows(spark):
    got, files = by_id(t.media_features(fixture(spark))), by_id(t.media_columns(fixture(spark)))
    same = {}
    for i, text, *_ in awkward():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r, media = got[i], bytes(files[i]["media"])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert t.from_wav(media) == (t.MULAW, t.RATE, payload)
        wide = t.from_wav(bytes(files[i]["pcm"]))[2]
        pcm = [mulaw(c) for c in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        peak = max(abs(v) for b in range(0, len(payload), t.BLOCK) for v in adpcm(payload[b : b + t.BLOCK]))
        rms = (sum(v * v for v in pcm) / len(pcm)) ** 0.5
        mean = sum(abs(alaw(c)) for c in payload) / len(payload)
        assert r["feature"] == f"rms={rms:.3f};crossings={turns};alaw_mean={mean:.3f};adpcm_peak={peak};pcm16k_crc={zlib.crc32(wide):08x}"
        assert same.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:]
    assert t.media_features(fixture(spark, [])).count() == 0
