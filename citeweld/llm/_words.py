"""Words of many texts at once, as numpy arrays over Arrow's own buffers.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, which is ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.
Texts are worked on in blocks of a few MB, so memory does not follow the size of an Arrow batch; a word's 64-bit hash
is a polynomial of its bytes, taken from running sums without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20  # bytes hashed at once, at most
STEP = 1 << 17  # bytes looked at together: what is made of them stays near the processor
CHUNK = 4 << 20  # bytes of whole texts handed out together
#: splitmix64's constants and odd multipliers of the hashes.
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit over all 64."""
    x = x ^ (x >> U(30))
    x *= MIX1
    x ^= x >> U(27)
    x *= MIX2
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1), modulo 2**64."""
    out, have = np.ones(n, U), 1
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * U(pow(base, have, 1 << 64))
        have += m
    return out


_tables: list[np.ndarray] = []


def _setup() -> tuple[np.ndarray, ...]:
    if not _tables:
        gap = np.zeros(256, bool)
        gap[[32, 9, 10, 11, 12, 13]] = True
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        table = mix(np.arange(1, 257, dtype=U) * U(BYTE_BASE))
        _tables.extend([gap, table[lower], table, _powers(BYTE_BASE, BLOCK + 1), _powers(pow(BYTE_BASE, -1, 1 << 64), BLOCK + 1)])
    return tuple(_tables)


@dataclass
class Chunk:
    """Some whole texts of a batch and their words."""

    first: int  #: number of the chunk's first text in the batch
    data: np.ndarray  #: bytes of the texts, one after another
    bounds: np.ndarray  #: where text i starts in data; one more entry than texts
    start: np.ndarray  #: where each word starts in data
    end: np.ndarray
    hash: np.ndarray  #: 64-bit hash of each word
    off: np.ndarray  #: words before text i; one more entry than texts

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        """The text (within the chunk) of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.off))


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes end a word."""
    return (data == 32) | (data - np.uint8(9) < 5)


def split_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data; a word never crosses a bound."""
    gap, low, table, power, inverse = _setup()
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    inner = bounds[1:-1]
    while at < n:
        stop = min(n, at + STEP)
        if stop < n:  # cut where a word ends
            back = int(blanks(data[at:stop])[::-1].argmax())  # characters behind the last blank; 0 also if there is none
            k = int(np.searchsorted(inner, stop, "right"))
            cut = max(stop - back if gap[data[stop - back - 1]] else 0, int(inner[k - 1]) if k else 0)
            if cut <= at:  # one word fills the step: find its end
                far = int(inner[k]) if k < len(inner) else n
                cut = stop
                while cut < far and not (here := blanks(data[cut : min(cut + BLOCK, far)])).any():
                    cut = min(cut + BLOCK, far)
                cut += int(here.argmax()) if cut < far else 0
            stop = cut
        part = data[at:stop]
        space = blanks(part)
        edge = np.zeros(len(part) + 1, bool)
        edge[0] = True
        edge[1:-1] = space[1:] != space[:-1]
        edge[-1] = True
        lo, hi = np.searchsorted(inner, at, "left"), np.searchsorted(inner, stop, "right")
        edge[inner[lo:hi] - at] = True
        edges = np.flatnonzero(edge)
        s, e = edges[:-1], edges[1:]
        word = ~space[s] if len(s) else np.zeros(0, bool)
        s, e = s[word], e[word]
        if len(s):
            value = (low if lower else table).take(part, mode="clip")
            if len(part) <= BLOCK:
                value *= power[: len(part)]
                total = np.zeros(len(part) + 1, U)
                np.cumsum(value, out=total[1:])
                h = (total[e] - total[s]) * inverse[s]
            else:  # a single word longer than a block: the same polynomial, block after block
                total = 0
                for i, x in enumerate(range(0, len(value), BLOCK)):
                    own = value[x : x + BLOCK]
                    total += int((own * power[: len(own)]).sum(dtype=U)) * pow(BYTE_BASE, i * BLOCK, 1 << 64)
                h = np.array([total % (1 << 64)], U)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix(h + (e - s).astype(U) * U(0x9E3779B97F4A7C15)))
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(starts, np.int64), join(ends, np.int64), join(hashes, U)


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = CHUNK) -> Iterator[Chunk]:
    """The texts in runs of about limit bytes (one text at least); a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        bounds = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        start, end, h = split_words(part, bounds, lower)
        yield Chunk(i, part, bounds, start, end, h, np.searchsorted(start, bounds, "left"))
        i = j


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans come in order, one after another, in at most BLOCK bytes."""
    _, _, table, power, inverse = _setup()
    out = np.empty(len(start), U)
    a = 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(start, start[a] + STEP, "left")))
        s, e = start[a:z] - start[a], end[a:z] - start[a]
        value = table.take(data[start[a] : end[z - 1]], mode="clip")
        value *= power[: len(value)]
        total = np.zeros(len(value) + 1, U)
        np.cumsum(value, out=total[1:])
        out[a:z] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
        a = z
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; len(h) - k + 1 of them, whatever text they belong to."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= WORD_BASE
        acc += h[i : i + n]
    return mix(acc)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] numbers, then those of the next range."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
