"""Vectorised hashed word features of whole texts.

A token is a run of letters, digits, underscores and bytes beyond ASCII, or a run of other signs; ASCII
letters count as lower case. A token equal to the one before it becomes the repeat token, so that any
repeated word gives the same feature. Long texts are looked at in chunks of at most ``STEP`` bytes, cut at
white space if a chunk has any, so memory does not grow with a text; a token that fills more is cut.
The hashes serve features only: nothing is compared for equality by them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text looked at once.
STEP = 1 << 17
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLASS = np.array([1 if c >= 128 or chr(c).isalnum() or c == 95 else 0 if chr(c).isspace() else 2 for c in range(256)], dtype=np.int8)
_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_EDGE = np.zeros(1, dtype=np.int8)
_powers = {name: np.cumprod(np.array([1] + [base] * STEP, dtype=np.uint64)) for name, base in (("up", BASE), ("down", INVERSE))}
REPEAT, SALT = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], alike wherever the span lies; at most ``STEP`` values."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers["up"][: len(values)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * _powers["down"][start])


def chunks(text: bytes, size: int = STEP) -> Iterator[tuple[int, bytes]]:
    """(offset, part) of a text in parts of at most ``size`` bytes, cut before white space where there is any."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(c, at + 1, at + size) for c in (b" ", b"\n", b"\t"))
        end = end if end > at else at + size
        yield at, text[at:end]
        at = end
    yield at, text[at:] if at else text


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the tokens of a lower-cased text of at most ``STEP`` bytes."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(text, dtype=np.uint8)
    kind = np.concatenate([_EDGE, _CLASS[raw], _EDGE])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    start, end = edge[:-1], edge[1:]
    full = kind[start + 1] > 0
    start, end = start[full], end[full]
    return _spans(_VALUE[raw], start, end), start, end


def features(texts: Iterable[str | None], bits: int, pairs: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, bucket, documents ended) for some text at a time: one entry for each word and each pair of neighbours.

    Documents count from the first one that has not ended yet.
    """
    held: list[bytes] = []
    size, plain, used = 0, None, None  # the last hash of a document that goes on, as it is and as a feature

    def flush(ends: bool) -> tuple[np.ndarray, np.ndarray, int]:
        nonlocal plain, used
        h, start, _ = tokens(b"\n".join(held))
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in held]), start, side="right")
        n = len(held) - (not ends)
        known = 0 if plain is None or not len(h) else 1  # only its own document is open, so it goes on here
        if known:
            h, doc = np.concatenate([[plain], h]), np.concatenate([[0], doc])
        if not len(h):
            plain, used = (None, None) if ends else (plain, used)
            return doc, doc, n
        same = doc[1:] == doc[:-1]
        word = h.copy()
        word[1:] = np.where(same & (h[1:] == h[:-1]), REPEAT, h[1:])
        if known:
            word[0] = used
        docs, hashes = [doc[known:]], [word[known:]]
        if pairs:
            docs.append(doc[1:][same])
            hashes.append(_mix(word[:-1] * SALT + word[1:])[same])
        plain, used = (None, None) if ends else (h[-1], word[-1])
        return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64), n

    for t in texts:
        raw = (t or "").encode().translate(_LOWER)
        if held and size + len(raw) + 1 > STEP:
            yield flush(True)
            held, size = [], 0
        if len(raw) < STEP:
            held.append(raw)
            size += len(raw) + 1
            continue
        parts = [part for _, part in chunks(raw, STEP - 1)]
        for i, part in enumerate(parts):
            held = [part]
            yield flush(i == len(parts) - 1)
        held, size = [], 0
    if held:
        yield flush(True)
