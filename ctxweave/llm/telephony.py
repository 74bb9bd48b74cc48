"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

mu-law and A-law expand by tables of 256 entries. ADPCM blocks are independent, so all
blocks of a batch are decoded side by side: one numpy step a sample position, however
many blocks there are. PCM is resampled by a polyphase windowed-sinc filter, all rows
of one length class together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxweave.runtime import prepare

RATE_IN, RATE_OUT, BLOCK = 8000, 16000, 256
CODECS = ("mulaw", "alaw", "ima_adpcm")


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    value = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte (ITU-T G.711)."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    value = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, value, -value).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
#: change of the predictor for each (step index, nibble), and the next step index
_CHANGE = np.array([[(-1 if n & 8 else 1) * ((s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)) for n in range(16)] for s in _STEP.tolist()], np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + _INDEX[None, :], 0, 88).astype(np.int32).ravel()


def adpcm_samples(n_bytes: np.ndarray | int, block: int = BLOCK) -> np.ndarray | int:
    """Samples that so many bytes of mono IMA ADPCM blocks hold; a last block without a whole header holds none."""
    rest = n_bytes % block
    return n_bytes // block * (2 * (block - 4) + 1) + np.where(rest >= 4, 2 * (rest - 4) + 1, 0)


def decode_adpcm(payloads: list[bytes], block: int = BLOCK) -> list[np.ndarray]:
    """Mono IMA ADPCM (block header: first sample, step index, one spare byte) to 16-bit PCM.

    The blocks of all payloads are the columns of one matrix, decoded together.
    """
    if block < 5:
        raise ValueError("a block has a header of 4 bytes and data")
    sizes = np.array([len(p) for p in payloads], np.int64)
    count = np.array([len(p) // block + (len(p) % block >= 4) for p in payloads], np.int64)
    total = int(count.sum())
    if not total:
        return [np.zeros(0, np.int16) for _ in payloads]
    raw = np.zeros((total, block), np.uint8)
    flat = raw.reshape(-1)
    at = 0
    for p, c in zip(payloads, count.tolist()):
        part = np.frombuffer(p, np.uint8)[: c * block]
        flat[at : at + len(part)] = part
        at += c * block
    head = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (block - 4) + 1, total), np.int16)
    out[0] = head
    data = np.ascontiguousarray(raw[:, 4:].T)
    value = head
    for k in range(block - 4):
        byte = data[k].astype(np.int32)
        for j, nibble in enumerate((byte & 15, byte >> 4)):
            code = (index << 4) + nibble
            value = np.clip(value + _CHANGE[code], -32768, 32767)
            index = _NEXT[code]
            out[2 * k + 1 + j] = value
    rows = np.ascontiguousarray(out.T).reshape(-1)
    starts = np.concatenate(([0], np.cumsum(count))) * out.shape[0]
    return [rows[a : a + n] for a, n in zip(starts[:-1].tolist(), adpcm_samples(sizes, block).tolist())]


@lru_cache(maxsize=16)
def filter_bank(up: int, down: int, half: int = 8) -> np.ndarray:
    """Polyphase taps (up, 2 * half) of a Hann-windowed sinc; each phase sums to 1."""
    cut = min(1.0, up / down)
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(t * cut) * cut * np.where(np.abs(t) <= half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0)
    return (taps / taps.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate_in: int, rate_out: int, half: int = 8) -> np.ndarray:
    """16-bit PCM at another rate: ceil(n * rate_out / rate_in) samples, edges held. half grows for lower rates."""
    if rate_in <= 0 or rate_out <= 0:
        raise ValueError("rates must be positive")
    if rate_in == rate_out or not len(pcm):
        return pcm.copy()
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    half = half * max(1, -(-down // up))
    taps = filter_bank(up, down, half)
    n = -(-len(pcm) * up // down)
    x = np.pad(pcm.astype(np.float32), (half - 1, half), mode="edge")
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs of one phase lie `down` inputs apart
        k = np.arange(first, n, up)
        phase, base = first * down % up, first * down // up
        if not len(k):
            continue
        acc = np.zeros(len(k), np.float32)
        for j, tap in enumerate(taps[phase]):
            part = x[base + j :: down][: len(k)]
            acc[: len(part)] += tap * part
        out[k] = acc
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def decode(payloads: list[bytes | None], codecs: list[str | None], block: int = BLOCK) -> list[np.ndarray | None]:
    """PCM of each payload; None for a null payload, a null codec or an unknown one."""
    out: list[np.ndarray | None] = [None] * len(payloads)
    for name, table in (("mulaw", MULAW), ("alaw", ALAW)):
        for k, (p, c) in enumerate(zip(payloads, codecs)):
            if p is not None and c == name:
                out[k] = table[np.frombuffer(p, np.uint8)]
    packed = [k for k, (p, c) in enumerate(zip(payloads, codecs)) if p is not None and c == "ima_adpcm"]
    for k, pcm in zip(packed, decode_adpcm([payloads[k] for k in packed], block)):
        out[k] = pcm
    return out


def _convert(rate_in: int, rate_out: int, block: int, most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, codecs = b.column(1).to_pylist(), b.column(2).to_pylist()
            k = 0
            while k < len(payloads):
                j, held = k, 0
                while j < len(payloads) and (j == k or held + len(payloads[j] or b"") <= most):
                    held += len(payloads[j] or b"")
                    j += 1
                pcm = decode(payloads[k:j], codecs[k:j], block)
                done = [None if x is None else resample(x, rate_in, rate_out) for x in pcm]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(k, j - k),
                        b.column(2).slice(k, j - k),
                        pa.array([None if x is None else len(x) for x in pcm], pa.int64()),
                        pa.array([None if x is None else rate_out for x in done], pa.int32()),
                        pa.array([None if x is None else x.astype("<i2").tobytes() for x in done], pa.binary()),
                    ],
                    names=["doc_id", "codec", "samples_in", "rate", "pcm"],
                )
                k = j

    return run


def to_pcm(audio: DataFrame, key: str, payload: str | Column, codec: str | Column, rate_in: int = RATE_IN, rate_out: int = RATE_OUT, block: int = BLOCK) -> DataFrame:
    """(doc_id, codec, samples_in, rate, pcm): little-endian 16-bit mono PCM of each row.

    A null payload, a null codec or one not in CODECS has null samples_in, rate and pcm.
    An empty payload has empty PCM, as has an ADPCM payload without a whole block
    header. Repeated rows are converted each by itself; a null key stays null. Other
    columns are not read. An empty table gives an empty result.
    """
    prepare(audio.sparkSession)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    source = audio.select(F.col(key).cast("long").alias("i"), as_column(payload).cast("binary").alias("p"), as_column(codec).cast("string").alias("c"))
    return source.mapInArrow(_convert(rate_in, rate_out, block), "doc_id long, codec string, samples_in long, rate int, pcm binary")
