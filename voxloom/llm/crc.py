"""CRC-32 of a concatenation from the CRCs of its parts, as columns of numbers.

The checksum without its first and last inversion is linear: raw(A + B) is raw(A)
carried over len(B) zero bytes, xor raw(B). Carrying is a 32 x 32 bit matrix; one is
kept for every power of two of the length, as four tables of 256 entries.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

POLY = 0xEDB88320
ONES = 0xFFFFFFFF


def raw_crc(data: bytes) -> int:
    """CRC-32 from state zero, without the last inversion."""
    return zlib.crc32(data, ONES) ^ ONES


def _tables(columns: np.ndarray) -> np.ndarray:
    """Four byte tables of the linear map whose value on bit i is columns[i]."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            step = 1 << bit
            out[byte, step : 2 * step] = out[byte, :step] ^ columns[8 * byte + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


@cache
def _powers() -> list[np.ndarray]:
    """Tables that carry over 2**k zero bytes, for k from 0 to 47."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = bits.copy()
    for _ in range(8):  # one zero byte: eight shifts
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLY), one >> 1).astype(np.uint32)
    found = [_tables(one)]
    for _ in range(47):
        found.append(_tables(_apply(found[-1], _apply(found[-1], bits))))
    return found


def carry(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each raw CRC after so many zero bytes."""
    out = np.asarray(crc).astype(np.uint32)
    n = np.asarray(n_bytes).astype(np.int64)
    for k, tables in enumerate(_powers()):
        if not (n >> k).any():
            break
        on = (n >> k) & 1 == 1
        if on.any():
            out[on] = _apply(tables, out[on])
    return out


def finish(raw: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The ordinary CRC-32 of data with this raw CRC and length."""
    return carry(np.full(len(raw), ONES, dtype=np.uint32), n_bytes) ^ np.asarray(raw).astype(np.uint32) ^ np.uint32(ONES)
