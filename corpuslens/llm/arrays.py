"""Words of many texts at a time, as numpy arrays. Used inside tasks, on the batches that Spark hands out."""

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are worked on together, and the longest word that is hashed with the others.
CHUNK, LONGEST = 1 << 20, 4096
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([1], np.full(n - 1, base, dtype=np.uint64))).astype(np.uint64))


POWERS = _powers(_BASE | 1, LONGEST)
#: White space as in [\x20\x09-\x0D]; every other byte belongs to a word.
NOT_SPACE = np.array([b not in (0x20, 9, 10, 11, 12, 13) for b in range(256)])
#: ASCII letters and digits after lower-casing, and everything outside ASCII.
LETTERS_DIGITS = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def spans(buffer: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in the bytes."""
    m = np.zeros(len(buffer) + 2, dtype=bool)
    m[1:-1] = is_word[buffer]
    edges = np.flatnonzero(m[1:] != m[:-1])
    return edges[0::2], edges[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters the bits of each 64-bit number."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    out = np.zeros(len(starts), dtype=np.uint64)
    lens = ends - starts
    ok = np.flatnonzero((lens <= LONGEST) & (lens > 0))
    for k in np.flatnonzero(lens > LONGEST):
        out[k] = xxhash.xxh64_intdigest(buffer[starts[k] : ends[k]].tobytes())
    step = np.cumsum(lens[ok]) // CHUNK
    for part in np.split(ok, np.flatnonzero(np.diff(step)) + 1):
        if len(part):
            n = lens[part]
            at = np.cumsum(n) - n
            within = np.arange(n.sum()) - np.repeat(at, n)
            values = (buffer[within + np.repeat(starts[part], n)].astype(np.uint64) + np.uint64(1)) * POWERS[within]
            out[part] = mix(np.add.reduceat(values, at))
    return out


class Words:
    """The words of some texts: lower-cased A-Z, split, hashed; ``doc`` is each word's text."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.bytes = b"\n".join(texts).lower()
        buffer = np.frombuffer(self.bytes, dtype=np.uint8)
        self.starts, self.ends = spans(buffer, is_word)
        self.hashes = span_hashes(buffer, self.starts, self.ends)
        self.text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.doc = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.firsts = np.cumsum(self.counts) - self.counts

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``size`` words of one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            h = h * np.uint64(_BASE | 1) + self.hashes[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(h[at])

    def text(self, i: int, size: int) -> bytes:
        return b" ".join(self.bytes[self.starts[k] : self.ends[k]] for k in range(i, i + size))
