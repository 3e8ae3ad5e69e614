"""Words, word shingles and byte windows of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

#: Fixed by the contracts: the bytes of ``[\x20\x09-\x0D]``.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: A random odd base for polynomial hashes modulo 2**64, and a random number per byte: for strings under 1,024 bytes or
#: numbers only, as longer strings of two alternating parts collide whatever the base.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of a long text that are hashed at a time.
SEGMENT = 1 << 22
#: Key of the hashes of longer words.
KEY = "hashes of words."
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, remembered up to 8 million."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have) if len(have) < 1 << 22 else 0)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offset of each text (one more than texts); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text comes alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, a longest run of bytes that aren't ``blank``; words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~blank[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | first[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of maximal runs of other than blank bytes in each text, a few megabytes at a time."""
    data, offsets = text_bytes(column)
    out = np.zeros(len(column), np.int64)
    for a, b in parts(offsets, SEGMENT):
        if b == a + 1:
            text = data[offsets[a] : offsets[b]]
            for at in range(0, len(text), SEGMENT):
                ink = ~IS_BLANK[text[max(at - 1, 0) : at + SEGMENT]]
                out[a] += int((ink[1:] & ~ink[:-1]).sum()) + (int(ink[0]) if at == 0 and len(ink) else 0)
            continue
        own = offsets[a : b + 1] - offsets[a]
        starts, _ = word_bounds(data[offsets[a] : offsets[b]], own)
        out[a:b] = np.diff(np.searchsorted(starts, own))
    return out


def kinds_of_words(chunk: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings from starts to ends, which don't overlap and are in order, and which of them each is."""
    edge = np.zeros(len(chunk) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = chunk[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    own = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(own), pa.py_buffer(inside)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def hash_words(chunk: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, for which no two words can be written that collide.

    Words of up to seven bytes and their lengths are numbers of their own, which
    are permuted; longer ones are hashed by a keyed SipHash, each distinct one once.
    """
    size = ends - starts
    padded = np.concatenate([chunk, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(chunk) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    kept = np.minimum(size, 7).astype(np.uint64)
    out = mix((eight[starts] & ((np.uint64(1) << (np.uint64(8) * kept)) - np.uint64(1))) | (kept << np.uint64(56)))
    long = size > 7
    if long.any():
        words, which = kinds_of_words(chunk, starts[long], ends[long])
        out[long] = hash_array(words.to_numpy(zero_copy_only=False), hash_key=KEY, categorize=False)[which]
    return out


def _word_hashes(chunk: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the first word of each text (one more than texts)."""
    starts, ends = word_bounds(chunk, own)
    return hash_words(chunk, starts, ends), np.searchsorted(starts, own)


def segments(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a text of about SEGMENT bytes that end at a blank; a longer word is a range of its own."""
    at = 0
    while at < len(text):
        to = min(len(text), at + SEGMENT)
        if to < len(text):
            blank = np.flatnonzero(IS_BLANK[text[at:to]])
            to = at + int(blank[-1]) + 1 if len(blank) else to
            while not len(blank) and to < len(text):  # the rest of a long word
                blank = np.flatnonzero(IS_BLANK[text[to : to + SEGMENT]])
                to = to + int(blank[0]) if len(blank) else min(len(text), to + SEGMENT)
        yield at, to
        at = to


def hashed_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first) for some texts at a time: the 64-bit hashes of all their words, the first of each text.

    A-Z count as a-z with ``lower``. A long text comes alone and is hashed in
    segments, so beside the text about 40 bytes a byte of SEGMENT and 8 bytes
    a word are held.
    """
    data, offsets = text_bytes(column)
    for a, b in parts(offsets):
        text, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        with np.errstate(over="ignore"):
            if len(text) <= SEGMENT or b - a > 1:
                yield _word_hashes(LOWER[text] if lower else text, own)
                continue
            found = []
            for at, to in segments(text):
                part = LOWER[text[at:to]] if lower else text[at:to]
                found.append(_word_hashes(part, np.array([0, len(part)]))[0])
            found = np.concatenate(found)
            yield found, np.array([0, len(found)])


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text its set of distinct shingles, as sorted 64-bit hashes.

    A-Z count as a-z. A text with fewer words is one shingle, its whole
    sequence; one without words has the empty set.
    """
    step = np.uint64(0xD6E8FEB86659FD93)
    for hashes, first in hashed_words(column):
        with np.errstate(over="ignore"):
            runs = np.full(max(0, len(hashes) - words + 1), words, np.uint64)
            for k in range(words):
                runs = mix(runs * step + hashes[k : k + len(runs)])
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                if hi - lo >= words:
                    yield np.unique(runs[lo : hi - words + 1])
                elif hi > lo:
                    h = np.full(1, hi - lo, np.uint64)
                    for k in range(lo, hi):
                        h = mix(h * step + hashes[k : k + 1])
                    yield h
                else:
                    yield np.zeros(0, np.uint64)
