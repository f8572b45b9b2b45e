"""Content-chosen anchors: equal windows of bytes choose the same place.

Every window of ``length`` bytes has an anchor, the leftmost place in it whose ``gram``
bytes have the least hash.  The choice depends on the window's bytes only, so windows
with equal bytes have equal grams at equal distances.  Windows that follow each other
and share an anchor make one segment; a random text has about ``2 / (length - gram)``
segments a byte.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(11)
CODES = _RANDOM.integers(0, 1 << 63, (2, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _RANDOM.integers(0, 1 << 62, 2, np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
BACK = np.array([pow(int(f), -1, 1 << 64) for f in FACTORS], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Running polynomial sums of a byte string: the hash of any substring in constant time."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    _back = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        if len(Sums._powers[which]) <= len(data):
            size = 1 << (len(data) + 1).bit_length()
            for table, factor in ((Sums._powers, FACTORS[which]), (Sums._back, BACK[which])):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                table[which] = np.multiply.accumulate(steps)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(CODES[which][data] * Sums._powers[which][:len(data)], out=self.sums[1:])

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[begins]) * Sums._back[self.which][begins]
        return mix(raw + (ends - begins).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Hash of every substring of ``size`` bytes."""
        count = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * Sums._back[self.which][:count] + np.uint64(size))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def segments(data: np.ndarray, stops: np.ndarray, length: int, gram: int):
    """Segments of texts laid one after the other (``stops``: where each ends).

    Returns (text, first window, last window, anchor, gram hash, hash of all the segment's bytes); places are
    those in ``data``.
    """
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return (nothing,) * 4 + (np.zeros(0, np.uint64),) * 2
    one = Sums(data, 0)
    codes = one.grams(gram)
    keyed = (codes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(codes), dtype=np.uint64)
    anchor = (sliding_least(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], stops[:-1]])
    changes = np.ones(len(anchor), bool)
    changes[1:] = anchor[1:] != anchor[:-1]
    inside = begins[begins < len(anchor)]
    changes[inside] = True
    over = np.maximum(stops - length + 1, begins)  # from here on windows reach into the next text
    changes[over[over < len(anchor)]] = True
    first = np.flatnonzero(changes)
    last = np.append(first[1:], len(anchor)) - 1
    text = np.searchsorted(stops, first, side="right")
    good = last + length <= stops[text]
    first, last, text = first[good], last[good], text[good]
    at = anchor[first]
    # the whole segment's bytes, and where its windows lie about the anchor
    whole = Sums(data, 1).hashes(first, last + length)
    whole = mix(whole + ((at - first) * 65536 + (at - last)).astype(np.uint64))
    return text, first, last, at, codes[at], whole
