"""Words and their 64-bit hashes for many texts at once, on byte arrays and without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``. White space of that pattern is ASCII, so words can be found in UTF-8 bytes. The hash of a
word is a polynomial over a random 64-bit value per byte, modulo 2**64; windows of words get a polynomial over word
hashes. Both come from prefix sums: with an odd base the inverse powers exist.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
BASE, WIDE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
CHUNK_BYTES = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept and grown on demand."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        inverse = U(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = U(1)
            both.append(np.multiply.accumulate(p))
        have = _powers[int(base)] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of the result are usable."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[starts:ends] for each span (ends exclusive), before mix()."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * down[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * up[ends]


class Words:
    """The words of some texts. start, end: byte offsets in data; hash: 64 bits; first[i]:first[i + 1] are text i's words."""

    __slots__ = ("data", "raw", "offset", "start", "end", "hash", "first")

    def __init__(self, texts: list[bytes], lower: bool = False):
        # a white-space byte after each text keeps words of neighbours apart
        self.data = b"\n".join(texts) + b"\n"
        if lower:
            self.data = self.data.lower()  # bytes.lower() changes A-Z only
        self.raw = np.frombuffer(self.data, dtype=np.uint8)
        self.offset = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offset[1:])
        word = np.zeros(len(self.raw) + 1, dtype=np.int8)
        word[1:] = ~IS_SPACE[self.raw]
        turn = np.diff(word)
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.hash = mix(spans_hash(BYTE[self.raw], self.start, self.end, BASE)) if len(self.start) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, self.offset)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of size words within a text, and the index of the first word of each."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = np.ones(n, dtype=bool)  # starts whose window stays in its text
        for k in self.first[1:]:
            inside[max(0, k - size + 1) : k] = False
        at = np.flatnonzero(inside)
        at = at[at + size <= n]
        return mix(spans_hash(self.hash, at, at + size, WIDE)), at


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(texts: Iterable[bytes], most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of about most bytes together; a longer text stands alone."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held
