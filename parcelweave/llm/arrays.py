"""Texts of an Arrow batch as numpy arrays: code points, word bounds, and hashes of any slice.

Everything here works on bounded slices of a batch (``blocks``); a single text is never cut.
Hashes are 64-bit polynomial sums over mixed code points: two different slices of one block
collide with a chance of about 5e-20 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SMALL = mix(np.arange(1, 65537, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next block of the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, and at least one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Texts:
    """The texts of a block end to end; null counts as empty.

    ``text`` is the joined string, ``codes`` its code points, ``bounds`` the n + 1 places where
    texts begin and end, counted in code points.
    """

    def __init__(self, column: pa.Array):
        raw = [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
        data = b"".join(raw)
        self.n = len(raw)
        self.text = data.decode("utf-8")
        self.codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0, *map(len, raw)])
        if len(data) == len(self.codes):
            self.bounds = ends
        else:
            first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            self.bounds = np.concatenate(([0], np.cumsum(first)))[ends]
        self._sums: np.ndarray | None = None

    def owners(self, places: np.ndarray) -> np.ndarray:
        """Index of the text that holds each place."""
        return np.searchsorted(self.bounds, places, "right") - 1

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of maximal runs of ``mask``; runs end where a text ends."""
        if not len(mask):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(mask))]
        begin = mask.copy()
        begin[1:] &= ~mask[:-1]
        begin[inner] = mask[inner]
        end = mask.copy()
        end[:-1] &= ~mask[1:]
        end[inner - 1] = mask[inner - 1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def words(self, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the words ``[^\\x20\\x09-\\x0D]+``."""
        c = self.codes if codes is None else codes
        return self.runs(~((c == 32) | ((c >= 9) & (c <= 13))))

    def hashes(self, begins: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """Hash of every slice, by differences of one running sum; equal slices have equal hashes.

        ``codes`` replaces the code points (as for folded case); give the same for all calls.
        """
        if self._sums is None:
            c = self.codes if codes is None else codes
            if len(c) and int(c.max()) >= 65536:
                values = mix(c.astype(np.uint64) + np.uint64(1))
            else:
                values = _SMALL[c]
            self._sums = np.zeros(len(c) + 1, np.uint64)
            np.cumsum(values * powers(BASE, len(c)), out=self._sums[1:])
        back = powers(BACK, len(self._sums))
        spans = (self._sums[ends] - self._sums[begins]) * back[begins]
        return mix(spans + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(codes: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all else stays."""
    return np.where((codes >= 65) & (codes <= 90), codes + 32, codes)


def per_text(owners: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Number (or integer sum of ``weights``) of entries of each text."""
    if weights is None:
        return np.bincount(owners, minlength=n).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(weights.astype(np.int64))))
    cuts = np.searchsorted(owners, np.arange(n + 1))
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _lower_table() -> np.ndarray:
    table = np.arange(65536, dtype=np.uint32)
    for code in range(65536):
        small = chr(code).lower()
        if len(small) == 1:
            table[code] = ord(small)
    return table


_LOWER = _lower_table()


def lower(codes: np.ndarray) -> np.ndarray:
    """Simple lower case, one code point for one; what lies beyond the basic plane stays."""
    return np.where(codes < 65536, _LOWER[np.minimum(codes, 65535)], codes)
