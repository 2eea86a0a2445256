"""Telephony audio columns: companded and ADPCM bytes in WAVE files, linear samples out.

Stored forms are RIFF/WAVE files with the standard format tags.  G.711 samples expand by
256-entry lookup tables; IMA ADPCM blocks decode with numpy across all blocks at once, a
vector step per sample position.  Decoded audio is resampled with integer arithmetic, so
results never depend on the machine.

Defined results: a null text counts as empty; an empty payload is 64 zero bytes (the
smallest block).  Equal payloads have equal stored forms and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialize, texts

# WAVE format tags and the IMA ADPCM step and index tables.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]

BLOCK = 64
RATE = 8000
#: Payload bytes decoded at a time; longer media go alone.
_GROUP = 4 << 20


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law code."""
    code = np.arange(256) ^ 0x55
    step, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(step == 0, low, (low + 256) << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
_STEPS, _INDEX = np.array(IMA_STEPS, dtype=np.int32), np.array(IMA_INDEX * 2, dtype=np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM mono blocks, an array of (blocks, bytes a block): the header's
    sample, then two for each byte, low half first.  One vector step per sample decodes
    that sample of every block.  Step indexes beyond the table count as its last."""
    n, width = blocks.shape
    out = np.empty((n, 2 * (width - 4) + 1), dtype=np.int16)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel()
    value, index = head.astype(np.int32), np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = head
    for k in range(out.shape[1] - 1):
        code = (blocks[:, 4 + k // 2] >> (4 * (k % 2))) & 15
        step = _STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * ((code >> 1) & 1) + step * ((code >> 2) & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + _INDEX[code], 0, 88)
        out[:, k + 1] = value
    return out


def encode_adpcm(samples: np.ndarray, width: int = BLOCK) -> np.ndarray:
    """IMA ADPCM blocks of 16-bit samples, (blocks, samples a block), across blocks."""
    n, length = samples.shape
    out = np.zeros((n, width), dtype=np.uint8)
    out[:, :2] = np.ascontiguousarray(samples[:, :1].astype("<i2")).view(np.uint8).reshape(n, 2)
    value, index = samples[:, 0].astype(np.int32), np.zeros(n, dtype=np.int32)
    for k in range(length - 1):
        step, gap = _STEPS[index], samples[:, k + 1].astype(np.int32) - value
        size = np.abs(gap)
        b4 = size >= step
        size = size - step * b4
        b2 = size >= step >> 1
        size = size - (step >> 1) * b2
        b1 = size >= step >> 2
        change = (step >> 3) + step * b4 + (step >> 1) * b2 + (step >> 2) * b1
        code = b4 * 4 + b2 * 2 + b1 * 1 + (gap < 0) * 8
        value = np.clip(np.where(gap < 0, value - change, value + change), -32768, 32767)
        index = np.clip(index + _INDEX[code], 0, 88)
        out[:, 4 + k // 2] |= (code << (4 * (k % 2))).astype(np.uint8)
    return out


def write_wave(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAVE file that holds ``payload`` unchanged: 8-bit codes, 16-bit PCM, or 64-byte ADPCM blocks."""
    tag = FORMATS[codec]
    align, bits = {"pcm": (2, 16), "ima_adpcm": (BLOCK, 4)}.get(codec, (1, 8))
    per_block = 2 * (BLOCK - 4) + 1
    each = rate * align // per_block if codec == "ima_adpcm" else rate * align
    fmt = struct.pack("<HHIIHH", tag, 1, rate, each, align, bits)
    fmt += struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else struct.pack("<H", 0) if codec != "pcm" else b""
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, bytes]:
    """(codec, sample rate, data bytes) of a WAVE file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in FORMATS.items() if v == tag), "")
        elif kind == b"data":
            if not codec or at + 8 + size > len(media):
                break
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no readable samples")


def decode(codec: str, data: np.ndarray) -> np.ndarray:
    """16-bit samples of stored bytes; whole ADPCM blocks only."""
    if codec == "mulaw":
        return MULAW[data]
    if codec == "alaw":
        return ALAW[data]
    if codec == "pcm":
        return data[: len(data) // 2 * 2].view("<i2")
    return decode_adpcm(data[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()


def _taps(shift: float, reach: int, cut: float) -> np.ndarray:
    """Integer weights, summing to 2**15, of the samples around a place ``shift`` after one of them,
    for a low-pass at ``cut`` of the source's band."""
    x = np.arange(-reach + 1, reach + 1) - shift
    w = np.sinc(x * cut) * np.cos(np.pi * np.clip(x / (2 * reach), -0.5, 0.5)) ** 2
    t = np.round(w / w.sum() * 32768).astype(np.int64)
    t[reach - 1] += 32768 - t.sum()
    return t


def resample(samples: np.ndarray, source: int, target: int, reach: int = 4) -> np.ndarray:
    """Samples at another rate by windowed-sinc filters in integers, a phase of the common multiple
    at a time; ends repeat.

    To a lower rate the filter also keeps out what that rate can't hold, and is longer by as
    much.  Memory follows the longer of input and output.
    """
    up = target // np.gcd(source, target)
    down = source // np.gcd(source, target)
    if len(samples) == 0 or up == down:
        return samples.astype(np.int16)
    cut = 1.0 if up > down else 0.9 * up / down
    half = int(np.ceil(reach / cut))
    x = np.pad(samples.astype(np.int32), (half - 1, half), mode="edge").astype(np.int64)
    out = np.empty(-(-len(samples) * up // down), dtype=np.int16)
    for phase in range(min(up, len(out))):
        base = np.arange(phase, len(out), up) * down // up
        taps = _taps(phase * down % up / up, half, cut)
        if taps[half - 1] == 32768:
            out[phase::up] = samples[base]
            continue
        total = np.zeros(len(base), dtype=np.int64)
        for k, t in enumerate(taps):
            total += t * x[base + k]
        out[phase::up] = np.clip((total + 16384) >> 15, -32768, 32767)
    return out


@dataclass(frozen=True)
class Audio:
    """What is known of one medium; ``pcm`` holds the resampled 16-bit samples."""

    codec: str
    data: bytes
    pcm: bytes
    feature: str


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, those bytes filled with zeros to a positive multiple of 64)."""
    raw = text.encode("utf-8")
    return len(raw), raw + b"\0" * (BLOCK * max(1, -(-len(raw) // BLOCK)) - len(raw))


def codec_of(payload: bytes) -> str:
    """The format that a payload is stored in, chosen by its checksum."""
    return ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(payload) % 3]


def analyse(media: list[bytes], target: int = 16000) -> list[Audio]:
    """Decode and measure many media; ADPCM blocks of the whole list decode together."""
    read = [read_wave(m) for m in media]
    pcm: list[np.ndarray | None] = [None] * len(read)
    together = [i for i, (codec, _, data) in enumerate(read) if codec == "ima_adpcm" and data]
    if together:
        blocks = np.frombuffer(b"".join(read[i][2] for i in together), dtype=np.uint8).reshape(-1, BLOCK)
        wave, at = decode_adpcm(blocks), 0
        for i in together:
            n = len(read[i][2]) // BLOCK
            pcm[i] = wave[at : at + n].ravel()
            at += n
    out = []
    for i, (codec, rate, data) in enumerate(read):
        x = decode(codec, np.frombuffer(data, dtype=np.uint8)) if pcm[i] is None else pcm[i]
        y = resample(x, rate, target)
        z = x.astype(np.int64)
        rms = int(np.sqrt((z * z).sum() / max(1, len(z))))
        crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
        raw = y.astype("<i2").tobytes()
        feature = f"{codec};n={len(x)};peak={int(np.abs(z).max(initial=0))};rms={rms};zc={crossings};pcm16k={zlib.crc32(raw):08x}"
        out.append(Audio(codec, data, raw, feature))
    return out


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's padded bytes as a telephony WAVE file, written to the shared folder."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for part in _parts(batch, lambda x: len(x or "")):
            made = [payload_of(x) for x in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([n for n, _ in made], pa.int64()),
                    pa.array([write_wave(p, codec_of(p)) for _, p in made], pa.binary()),
                ],
                names=[key, "n_bytes", "media"],
            )

    return materialize(map_batches(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, media binary"))


def features(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes", pcm: bool = False) -> DataFrame:
    """Read stored media back: digests of what they hold, features, and on request ``pcm``."""
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string" + ", pcm binary" * pcm
    )

    def run(batch: pa.RecordBatch):
        for part in _parts(batch, lambda x: len(x or b""), column=2):
            stored = part.column(2).to_pylist()
            found = analyse(stored)
            columns = [
                part.column(0),
                part.column(1),
                pa.array([len(a.data) for a in found], pa.int64()),
                pa.array([hashlib.sha256(a.data).hexdigest() for a in found], pa.string()),
                pa.array([zlib.crc32(a.data[-BLOCK:]) for a in found], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored], pa.string()),
                pa.array([a.feature for a in found], pa.string()),
            ]
            names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if pcm:
                columns.append(pa.array([a.pcm for a in found], pa.binary()))
                names.append("pcm")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(df.select(key, n_bytes, media), run, schema)


def store_pcm(df: DataFrame, key: str = "doc_id", media: str = "media", target: int = 16000) -> DataFrame:
    """(key, pcm): stored media as WAVE files of linear 16-bit samples at ``target`` a second, written to the shared folder."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for part in _parts(batch, lambda x: len(x or b"")):
            made = [write_wave(a.pcm, "pcm", target) for a in analyse(part.column(1).to_pylist(), target)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=[key, "pcm"])

    return materialize(map_batches(df.select(key, media), run, f"`{key}` {kind}, pcm binary"))


def _parts(batch: pa.RecordBatch, size, column: int = 1):
    """The batch in runs of about ``_GROUP`` bytes, so that memory doesn't follow the batch."""
    start = total = 0
    for i, x in enumerate(batch.column(column)):
        total += size(x.as_py())
        if total >= _GROUP:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows or batch.num_rows == 0:
        yield batch.slice(start)
