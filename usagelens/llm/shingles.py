"""Word shingles of whole batches of texts, as arrays.

A word is a run of ASCII letters, digits and underscores or of characters beyond ASCII, in
lower case; a shingle is five consecutive words. A text of fewer words is one shingle, and
so is a text without any word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text handled at once; a longer text is handled alone.
_PIECE = 1_000_000

_rng = np.random.default_rng(20240601)
_LETTER = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(x) for x in (_rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) | np.uint64(1))]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[str]) -> Iterator[list[bytes]]:
    """The texts in lower case as UTF-8, in lists of bounded size."""
    held, size = [], 0
    for text in texts:
        data = text.lower().encode("utf-8", "surrogatepass")
        if held and size + len(data) > _PIECE:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles, ordered by text and shingle."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, stops = edge[::2], edge[1::2]
    if len(starts):
        lengths = stops - starts
        first = np.cumsum(lengths) - lengths
        place = (np.arange(lengths.sum()) - np.repeat(first, lengths)) & (len(_PLACE) - 1)
        words = mix(np.add.reduceat(_LETTER[data[inside]] * _PLACE[place], first) + lengths.astype(np.uint64))
    else:
        words = np.zeros(0, np.uint64)
    owner = np.searchsorted(ends, starts, side="right")
    n = max(0, len(words) - WORDS + 1)
    whole = owner[:n] == owner[WORDS - 1 :] if n else np.zeros(0, bool)
    code = np.zeros(n, np.uint64)
    for k in range(WORDS):
        code += words[k : k + n] * _STEP[k]
    text, code = owner[:n][whole], mix(code[whole])
    short = np.flatnonzero(np.bincount(owner, minlength=len(texts)) < WORDS)
    if len(short):
        text = np.concatenate((text, short))
        code = np.concatenate((code, [_short(texts[i], words[owner == i]) for i in short]))
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (code[1:] != code[:-1])))
    at = np.flatnonzero(new)
    return text[at], code[at], np.diff(np.append(at, len(code)))


def _short(text: bytes, words: np.ndarray) -> np.uint64:
    data = words.tobytes() if len(words) else text
    return np.uint64(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big"))
