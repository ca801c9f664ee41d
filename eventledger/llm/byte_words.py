"""Hashes of the words of many texts at once, over their bytes."""

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the prime and of its inverse modulo 2**64, up to n."""
    if len(_POWERS[0]) < n + 1:
        for i, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _table(inside: np.ndarray) -> np.ndarray:
    """Per byte what it counts as in a word (A-Z as a-z; the byte plus 1), and 0 between words."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[ord("A") : ord("Z") + 1] += 32
    return np.where(inside, table, 0).astype(np.uint16)


def letters_and_digits() -> np.ndarray:
    """Words are ASCII letters and digits and everything that is not ASCII."""
    inside = np.zeros(256, bool)
    inside[0x80:] = True
    for first, last in ("09", "az", "AZ"):
        inside[ord(first) : ord(last) + 1] = True
    return _table(inside)


def not_space() -> np.ndarray:
    """Words are what ASCII white space parts."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return _table(inside)


def joined_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, each followed by a space; where each begins, and the end."""
    raw = [(t or "").encode("utf-8") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    return data, np.concatenate([np.zeros(1, np.int64), ends]) if raw else np.zeros(1, np.int64)


def word_hashes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in ``data``, which ends with a separator."""
    folded = table[data]
    inside = folded != 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    forward, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * forward[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * back[starts]
    return mixed(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(56))), starts, ends


def chunks(texts: list, room: int = 1 << 21):
    """Slices of a list of texts of about ``room`` characters in all."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= room:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
