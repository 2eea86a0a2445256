"""Content-defined chunks: cuts depend on the bytes nearby, so equal passages have equal chunks."""

from __future__ import annotations

import hashlib

import numpy as np

WINDOW = 32


def _gear() -> np.ndarray:
    """A pseudo-random 32-bit value for each byte, by rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at every byte: each byte's value, shifted by its distance, summed."""
    h = GEAR[data]
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def bounds(raw: bytes, mean: int = 1024, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of UTF-8 bytes; none within a character.

    Cuts stand where the top bits of the rolling hash are 0, on average every ``mean`` bytes;
    those closer than ``least`` to the last cut don't count, and after ``most`` bytes without
    one the chunk ends all the same.
    """
    n = len(raw)
    if n <= least:
        return [n] if n else []
    data = np.frombuffer(raw, dtype=np.uint8)
    bits = max(1, int(mean - least).bit_length() - 1)
    spots = np.flatnonzero(rolling(data) >> np.uint32(32 - bits) == 0) + 1
    starts = (data & 0xC0) != 0x80
    out, last = [], 0
    at, spots = 0, spots.tolist()
    while n - last > least:
        while at < len(spots) and spots[at] < last + least:
            at += 1
        end = min(spots[at] if at < len(spots) else n, last + most, n)
        while end < n and not starts[end]:
            end += 1
        out.append(end)
        last = end
    if last < n:
        if out:
            out[-1] = n
        else:
            out.append(n)
    return out
