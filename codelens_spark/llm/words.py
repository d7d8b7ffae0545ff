"""Words and word shingles of UTF-8 texts as 64-bit hashes, computed on whole Arrow buffers with numpy.

A word is a maximal run of bytes other than blank and \\t..\\r (`[^\\x20\\x09-\\x0D]+`); A-Z count as a-z. All work is on
bytes, so any text (any language, any length) is treated alike. Texts are worked off in pieces of a few MB cut at
white space, which bounds memory whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
PIECE = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _fixed(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _fixed(11, 256)
_BYTE[ord("A"): ord("Z") + 1] = _BYTE[ord("a"): ord("z") + 1]
_PLACE = _fixed(12, SHINGLE)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_R = int(_fixed(13, 1)[0])
_R_INV = pow(_R, -1, 2**64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _POW or len(_POW["r"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("r", _R), ("i", _R_INV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["r"][:n], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads the bits of 64-bit sums."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _word_hashes(b: np.ndarray, breaks: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `b` and where each starts; no word crosses a position of `breaks`."""
    word = ~gap[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(b))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.uint64), start
    power, inverse = _powers(len(b))
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _MUL), start


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, from byte, to byte): whole texts up to PIECE bytes, longer texts cut at white space."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > PIECE:
            lo, hi = int(at[i]), int(at[i + 1])
            while lo < hi:
                cut = min(hi, lo + PIECE)
                while cut < hi and not _BLANK[data[cut]]:
                    step = np.flatnonzero(_BLANK[data[cut: cut + PIECE]])
                    cut = min(hi, cut + (int(step[0]) if len(step) else PIECE))
                yield i, i + 1, lo, cut
                lo = cut
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            yield i, j, int(at[i]), int(at[j])
            i = j


def word_hashes(column: pa.Array, gap: np.ndarray = _BLANK) -> Iterator[np.ndarray]:
    """For each text, in order, the hashes of its words. `gap` marks the bytes between words, white space among them."""
    data, at = text_buffers(column)
    pending: list[np.ndarray] = []
    for i, j, lo, hi in _pieces(data, at):
        words, start = _word_hashes(data[lo:hi], at[i:j] - lo, gap)
        if at[i] < lo or hi < at[j]:  # part of one long text
            pending.append(words)
            if hi == at[j]:
                yield np.concatenate(pending)
                pending = []
            continue
        cut = np.searchsorted(start, at[i: j + 1] - lo)
        for k in range(j - i):
            yield words[cut[k]: cut[k + 1]]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes: of SHINGLE words each, or the whole sequence if it is shorter."""
    m = len(words) - SHINGLE + 1
    if m < 1:
        if not len(words):
            return words
        return mix(np.sum(words * _PLACE[: len(words)], keepdims=True) + np.uint64(len(words)))
    s = words[:m] * _PLACE[0]
    for j in range(1, SHINGLE):
        s += words[j: j + m] * _PLACE[j]
    s = mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, in order, its set of shingles; empty for a text without words."""
    return map(shingle_set, word_hashes(column))
