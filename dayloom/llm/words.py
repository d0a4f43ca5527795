"""Words, shingles and their hashes over whole Arrow batches of text.

A word is a maximal run of ASCII letters and digits and of characters outside
ASCII; A-Z count as a-z. Everything works on the bytes of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)

_BYTE = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _BYTE[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one (the splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (with a last entry for the end)."""
    low = _BYTE[data]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = ends[:-1][np.diff(ends) > 0]
    first[starts_of_text] = inside[starts_of_text]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[starts_of_text[1:] - 1] = inside[starts_of_text[1:] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[low] * powers(_BASE, len(data)), out=total[1:])
    hashes = mix((total[end] - total[begin]) * powers(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(U))
    return hashes, np.searchsorted(begin, ends)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and the index of its text, in order. A text of 1 to width - 1 words has one shingle, all its words."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    if len(words) >= width:
        m = len(words) - width + 1
        h = words[:m].copy()
        for k in range(1, width):
            h *= _STEP
            h += words[k : m + k]
        whole = text[:m] == text[width - 1 :]
        h, of = mix(h[whole]), text[:m][whole]
    else:
        h, of = np.zeros(0, U), np.zeros(0, np.int64)
    if len(few := np.flatnonzero((n > 0) & (n < width))):
        extra = np.zeros(len(few), U)
        for k in range(width - 1):
            has = n[few] > k
            extra[has] = extra[has] * _STEP + words[at[few[has]] + k]
        h, of = np.concatenate([h, mix(extra + U(1))]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of


def sequence_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words; texts with the same words in the same order agree."""
    out = []
    for base in (U(0xA0761D6478BD642F | 1), U(0xE7037ED1A0B428DB | 1)):
        inverse = U(pow(int(base), -1, 1 << 64))
        total = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words ^ base) * powers(base, len(words)), out=total[1:])
        out.append(mix((total[at[1:]] - total[at[:-1]]) * powers(inverse, len(words) + 1)[at[:-1]] + np.diff(at).astype(U)))
    return out[0], out[1]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Cut a batch into runs of rows whose texts hold about limit bytes, so memory stays bounded."""
    ends = utf8(batch.column(batch.schema.get_field_index(column)))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches, column: str, limit: int = 16_000_000):
    """Tables of consecutive rows whose texts hold about limit bytes, from batches of any size."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, limit):
            held.append(part)
            size += part.column(part.schema.get_field_index(column)).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered_words(texts: pa.Array, inside: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of every word, the words by number, and for each text the index of its first word (with a last entry for the end).

    A word is a maximal run of bytes of which inside is true; fold gives the byte that each counts as.
    """
    data, ends = utf8(texts)
    on = inside[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    starts = ends[:-1][np.diff(ends) > 0]
    first[starts] = on[starts]
    last = on.copy()
    last[:-1] &= ~on[1:]
    last[starts[1:] - 1] = on[starts[1:] - 1]
    begin = np.flatnonzero(first)
    body, where = fold[data[on]], np.append(0, np.cumsum(np.flatnonzero(last) + 1 - begin))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(where), pa.py_buffer(body)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, np.searchsorted(begin, ends)


#: A-Z count as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
