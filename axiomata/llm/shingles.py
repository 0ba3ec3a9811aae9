"""Sets of word shingles as 64-bit numbers, computed over whole batches of texts at once.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. Its
number is a polynomial over random per-byte values, taken from running sums, so no word is ever
a Python object. A shingle's number combines those of its words. Numbers are 64 bits and well
mixed: two different shingles of a pair of documents agree with a chance of about 1e-13.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes that are hashed together; a longer word is hashed whole all the same.
STRETCH = 1 << 19

_rng = np.random.default_rng(20260102)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _rng.integers(0, 2**64, 256, np.uint64)[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, STRETCH + 4096), base)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, number) of each word of a byte array."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        while end < len(raw):  # to the next space
            gap = np.flatnonzero(_SPACE[raw[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + 4096)
        part = raw[at:end]
        blank = np.ones(len(part) + 2, bool)
        blank[1:-1] = _SPACE[part]
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = turns[::2], turns[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * _power("up", _BASE, len(part)), out=sums[1:])
        number = (sums[last] - sums[first]) * _power("down", _BACK, len(part) + 1)[first]
        found.append((first + at, last + at, mixed(number + (last - first).astype(np.uint64))))
        at = end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    first, last, number = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, last, number


def sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle numbers of each text; a text of under ``n`` words has one shingle, one without words none."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    first, _, number = words(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.concatenate([[0], np.searchsorted(first, ends)])
    whole = np.zeros(max(0, len(number) - n + 1), np.uint64)
    for k in range(n):
        whole += number[k : k + len(whole)] * _PLACE[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mixed(np.array([(number[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
