"""Vectorised word hashing over Arrow text columns.

Tasks that need every word of every text work on the bytes of a whole slice
of rows at once: a lookup table marks word bytes, and word starts and ends
follow from it.  A word is hashed eight bytes at a time, each step through a
non-linear finaliser; words beyond 64 bytes take BLAKE2b.  ``second`` is an
independent hash of the same words.  Operators whose results rest on which
words are equal draw a ``secret``: then both are multilinear hashes under numbers
that come from it, for which two different words meet with a chance of 2^-64
each, whoever chose them.  Runs of words are hashed as trees over the hashes of their words.
Texts are never cut; a slice only bounds how many bytes are in memory together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: For tasks with many numbers per word.
SMALL_SLICE = 1 << 20
#: Odd multipliers and seeds of the two independent hashes.
_ODD, _SEEDS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0x243F6A8885A308D3), np.uint64(0xA4093822299F31D0))
#: Words of more bytes are hashed one at a time.
STEPPED = 64


def byte_table(separators: bytes, lower: bool = False, invert: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is-word-byte, byte mapping) tables; ``invert`` takes the bytes as word bytes."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    if invert:
        word = ~word
    mapping = np.arange(256, dtype=np.uint8)
    if lower:
        mapping[65:91] += 32
        word[65:91] = word[97:123]
    return word, mapping


#: Words between ASCII white space, unchanged and with A-Z lowered.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACED_LOWER = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
#: Runs of letters and digits; every non-ASCII byte counts as a letter.
ALNUM_LOWER = byte_table(bytes([*range(48), *range(58, 97), *range(123, 128)]), lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``; ``side`` 0 and 1 are independent."""
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) * _ODD + _SEEDS[side])
    if not len(starts):
        return hashes
    loads = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    which = np.flatnonzero(lengths <= STEPPED)
    for at in range(0, min(STEPPED, int(lengths.max())), 8):
        which = which[lengths[which] > at]
        spare = np.maximum(0, at + 8 - lengths[which]).astype(np.uint64) * np.uint64(8)
        chunk = loads[starts[which] + at] << spare  # bytes behind the end fall out
        hashes[which] = mix((hashes[which] ^ mix(chunk + _SEEDS[side])) * _ODD + _SEEDS[1 - side])
    for i in np.flatnonzero(lengths > STEPPED).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        hashes[i] = np.frombuffer(digest, "<u8")[side]
    return hashes


@dataclass
class Words:
    """Words of consecutive rows: ``hashes[bounds[i]:bounds[i + 1]]`` is row i; ``data`` is as given, ``mapped`` as hashed."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    mapped: np.ndarray
    secret: bytes | None = None

    @property
    def second(self) -> np.ndarray:
        """An independent hash of every word."""
        if self.secret is not None:
            return hash_secret(self.mapped, self.starts, self.ends, self.secret, 1)
        return hash_spans(self.mapped, self.starts, self.ends, 1)


def hash_secret(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, secret: bytes, side: int) -> np.ndarray:
    """64 bits from two multilinear hashes over 32-bit parts of ``data[starts[i]:ends[i]]`` and its length.

    Each is the upper half of k0 + k1 x1 + k2 x2 + ... modulo 2^64, with random k.
    """
    raw = hashlib.shake_256(secret + bytes([side])).digest(2 * 8 * (STEPPED // 4 + 2))
    keys = np.frombuffer(raw, "<u8").reshape(2, -1)
    lengths = ends - starts
    sums = [k[0] + k[1] * lengths.astype(np.uint64) for k in keys]
    if not len(starts):
        return sums[0]
    loads = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    which = np.arange(len(starts))
    for at in range(0, min(STEPPED, int(lengths.max())), 8):
        if at:
            which = which[lengths[which] > at]
        spare = np.maximum(0, at + 8 - lengths[which]).astype(np.uint64) * np.uint64(8)
        chunk = loads[starts[which] + at] << spare  # bytes behind the end fall out
        low, high = chunk & np.uint64(0xFFFFFFFF), chunk >> np.uint64(32)
        for total, k in zip(sums, keys):
            part = k[2 + at // 4] * low + k[3 + at // 4] * high
            if at:
                total[which] += part
            else:
                total += part
    hashes = (sums[0] & np.uint64(0xFFFFFFFF00000000)) | sums[1] >> np.uint64(32)
    for i in np.flatnonzero(lengths > STEPPED).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=secret).digest()
        hashes[i] = np.frombuffer(digest, "<u8")[side]
    return hashes


def words_of(column: pa.Array, table: tuple[np.ndarray, np.ndarray] = SPACED, secret: bytes | None = None) -> Words:
    """Hash the words of a string column, under ``secret`` if there is one; null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]) if len(offsets) else 0, int(offsets[-1]) if len(offsets) else 0
    offsets = offsets - first
    body = column.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[first:last] if body is not None and last > first else np.zeros(0, np.uint8)
    is_word, mapping = table
    data, inside = mapping[raw], is_word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    closes = offsets[1:][offsets[1:] > 0] - 1
    finishes[closes] = inside[closes] if len(raw) else False
    ends = np.flatnonzero(finishes) + 1
    bounds = np.searchsorted(starts, offsets)
    if secret is not None:
        return Words(hash_secret(data, starts, ends, secret, 0), bounds, starts, ends, raw, data, secret=secret)
    return Words(hash_spans(data, starts, ends), bounds, starts, ends, raw, data)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that a slice holds about ``size`` bytes of text; a longer row stands alone."""
    if not batch.num_rows:
        return
    lengths = pc.binary_length(batch.column(column).cast(pa.large_binary()).fill_null(b"")).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two runs, one behind the other, from theirs."""
    return mix(left * _ODD + mix(right))


def rolling(hashes: np.ndarray, bounds: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of ``size`` words inside one row, and the index of their first word."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, width, total, done = hashes ^ np.uint64((seed * int(_ODD)) % (1 << 64)), 1, None, 0
    while True:  # runs of 1, 2, 4, ... words; those of the binary digits of ``size`` make up the run
        if size & width:
            part = power[done : done + n - size + 1]
            total, done = part if total is None else joined(total, part), done + width
        if 2 * width > size:
            break
        power, width = joined(power[:-width], power[width:]), 2 * width
    at = np.arange(n - size + 1)
    whole = np.repeat(bounds[1:], np.diff(bounds))[: n - size + 1]
    at = at[at + size <= whole]
    return mix(total[at] + np.uint64(size)), at


def prefix_hashes(found: Words, which: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the first ``length`` bytes of some words, each longer than that."""
    return mix(hash_spans(found.mapped, found.starts[which], found.starts[which] + length, 1))
