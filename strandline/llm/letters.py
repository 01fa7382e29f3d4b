"""Letters of a sequence, and NumPy kernels over many sequences at once.

*Letters* are the characters A-Z and a-z of a sequence, in order, in upper case; positions count letters from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

def letters(column: Column) -> Column:
    """The letters of a sequence column; null stays null."""
    return F.upper(F.regexp_replace(column, "[^A-Za-z]+", ""))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column end to end without a copy, and each row's number of bytes; null has none."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], np.diff(at)


#: The first byte of a packed text: letters that fill up its last byte, or that the letters follow as they are.
_PLAIN = 4


def pack(codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts, given end to end, as binary values: four letters a byte where all are A, C, G or T."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    two = np.full(256, 4, np.uint8)
    two[[65, 67, 71, 84]] = range(4)
    bits = two[codes]
    odd = np.concatenate(([0], np.cumsum(bits == 4)))
    plain = odd[starts + lengths] > odd[starts]
    fill = np.where(plain, _PLAIN, -lengths % 4)
    size = 1 + np.where(plain, lengths, (lengths + fill) // 4)
    edge = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(edge[-1]), np.uint8)
    out[edge[:-1]] = fill
    some = np.flatnonzero(plain)
    out[spread(edge[some] + 1, lengths[some])] = codes[spread(starts[some], lengths[some])]
    some = np.flatnonzero(~plain)
    padded = 4 * (size[some] - 1)
    four = np.zeros(int(padded.sum()), np.uint8)
    at = np.concatenate(([0], np.cumsum(padded)[:-1])) if len(some) else np.zeros(0, np.int64)
    four[spread(at, lengths[some])] = bits[spread(starts[some], lengths[some])]
    four = four.reshape(-1, 4)
    out[spread(edge[some] + 1, size[some] - 1)] = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of packed texts."""
    data, size = joined(column)
    edge = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    fill = data[edge[:-1]]
    plain = fill == _PLAIN
    lengths = np.where(plain, size - 1, 4 * (size - 1) - fill)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    out = np.zeros(int(lengths.sum()), np.uint8)
    some = np.flatnonzero(plain)
    out[spread(starts[some], lengths[some])] = data[spread(edge[some] + 1, lengths[some])]
    some = np.flatnonzero(~plain)
    four = data[spread(edge[some] + 1, size[some] - 1)]
    letter = np.frombuffer(b"ACGT", np.uint8)[(four[:, None] >> np.array([0, 2, 4, 6], np.uint8) & np.uint8(3)).reshape(-1)]
    at = np.concatenate(([0], np.cumsum(4 * (size[some] - 1))[:-1])) if len(some) else np.zeros(0, np.int64)
    out[spread(starts[some], lengths[some])] = letter[spread(at, lengths[some])]
    return out, lengths


def window_hashes(codes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A 64-bit polynomial hash of each window of ``width`` bytes of ``codes``.

    Equal windows have equal hashes; unequal ones may collide, so callers that must be exact compare the bytes as well.
    """
    return windows_hashes(codes, (width,), salt)[0]


def windows_hashes(codes: np.ndarray, widths: tuple[int, ...], salt: int) -> list[np.ndarray]:
    """``window_hashes`` for several widths at once: windows of 1, 2, 4, ... bytes are shared between them."""
    rng = np.random.default_rng(salt)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**62)) * 4 + 3
    power = table[codes]
    reach, out = 1, {w: (0, None) for w in widths}
    while True:
        for w in widths:
            done, now = out[w]
            if w & reach and len(codes) >= w:
                n = len(codes) - done - reach + 1
                step = power[:n] if now is None else now[:n] * np.uint64(pow(base, reach, 2**64)) + power[done : done + n]
                out[w] = (done + reach, step)
        if reach * 2 > max(widths) or len(codes) < 2 * reach:
            break
        n = len(codes) - 2 * reach + 1
        power = power[:n] * np.uint64(pow(base, reach, 2**64)) + power[reach : reach + n]
        reach *= 2
    return [mixed(out[w][1]) if len(codes) >= w else np.zeros(0, np.uint64) for w in widths]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread over the whole word; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for each other row."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def packed(text: np.ndarray, width: int) -> np.ndarray:
    """Each run of ``width`` (up to 12) letters as an integer that sorts as the letters do; beyond the end, as if blanks
    followed."""
    one = np.concatenate((text & np.uint8(31), np.zeros(width, np.uint8))).astype(np.uint64)
    out, have, power, reach = None, 0, one, 1
    while True:
        if width & reach:
            n = len(power) - have if out is not None else len(power)
            out = power if out is None else (out[:n] << np.uint64(5 * reach)) | power[have : have + n]
            have += reach
        if reach * 2 > width:
            return out[: len(text)]
        power = (power[:-reach] << np.uint64(5 * reach)) | power[reach:]
        reach *= 2
