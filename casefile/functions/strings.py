"""Runs of printable characters in bytes, as numpy masks.

Two encodings are looked for: ASCII (one byte a character) and UTF-16LE limited to the
ASCII characters (a printable byte and a zero, at even or odd offsets).  A run is maximal;
runs shorter than ``least`` characters are left out.

``runs`` works on a whole buffer, ``RunScanner`` on consecutive chunks of one file: it holds
back the bytes of a run that is still open at the seam, so that chunk borders change
nothing.  Memory is bounded by ``longest``: a run of more characters comes in pieces of
exactly that many (the last may be shorter, also than ``least``), each with its own offset.
"""

from __future__ import annotations

import numpy as np

ASCII, WIDE = "ascii", "utf-16le"
LEAST = 4
LONGEST = 1 << 20

# Blank to tilde, and the tab.
PRINTABLE = np.zeros(256, bool)
PRINTABLE[0x20:0x7F] = True
PRINTABLE[0x09] = True


def _stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of stretches of at least ``least`` true values."""
    turns = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    long = end - begin >= least
    return begin[long], end[long]


def runs(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, characters, whether wide) of all runs in a byte array: ASCII ones by offset, then wide ones."""
    printable = PRINTABLE[data]
    begin, end = _stretches(printable, least)
    found = [(begin, end - begin, np.zeros(len(begin), bool))]
    if len(data) >= 2 * least:
        pair = printable[:-1] & (data[1:] == 0)
        if pair.any():
            wide = []
            for parity in (0, 1):
                b, e = _stretches(pair[parity::2], least)
                wide.append((2 * b + parity, e - b))
            at, size = (np.concatenate(x) for x in zip(*wide))
            order = np.argsort(at)
            found.append((at[order], size[order], np.ones(len(at), bool)))
    return tuple(np.concatenate(x) for x in zip(*found))


def pieces(offset: int, text: str, wide: bool, longest: int) -> list[tuple[int, str, str]]:
    """(offset, encoding, text) of one run, cut into pieces of ``longest`` characters."""
    step = 2 if wide else 1
    return [(offset + step * n, WIDE if wide else ASCII, text[n:n + longest]) for n in range(0, len(text), longest)]


def strings_of(data: bytes, least: int = LEAST, longest: int = LONGEST) -> list[tuple[int, str, str]]:
    """(offset, encoding, text) of every run in a whole content."""
    out = []
    for at, size, wide in zip(*(x.tolist() for x in runs(np.frombuffer(data, np.uint8), least))):
        text = data[at:at + 2 * size:2] if wide else data[at:at + size]
        out += pieces(at, text.decode("ascii"), wide, longest)
    return out


class RunScanner:
    """The same runs from consecutive chunks; ``feed`` returns those that have ended, ``close`` the open ones."""

    def __init__(self, least: int = LEAST, longest: int = LONGEST):
        self.least, self.longest = least, longest
        self.at = 0              # file offset of the next chunk
        self.open_ascii = b""    # the open ASCII run's last characters, not given out yet
        self.ascii_given = 0     # characters of it that were given out
        self.open_wide = [b"", b""]  # by parity of the file offset at which the pair begins
        self.wide_given = [0, 0]
        self.last = b""          # the byte before the seam: it may begin a pair

    def _give(self, end: int, text: bytes, given: int, wide: bool, ended: bool) -> tuple[list, bytes, int]:
        """Whole pieces of an open run that reaches up to file offset ``end``, and the rest if it has ended."""
        out, step = [], 2 if wide else 1
        begin = end - step * len(text)
        whole = len(text) - len(text) % self.longest
        if given + len(text) < self.least:  # too short, or not known yet
            return [], b"" if ended else text, 0 if ended else given
        for n in range(0, len(text) if ended else whole, self.longest):
            out.append((begin + step * n, WIDE if wide else ASCII, text[n:n + self.longest].decode("ascii")))
        return (out, b"", 0) if ended else (out, text[whole:], given + whole)

    def feed(self, chunk: bytes) -> list[tuple[int, str, str]]:
        if not chunk:
            return []
        out = self._ascii(np.frombuffer(chunk, np.uint8), chunk)
        joined = self.last + chunk  # pairs begin up to the last byte but one
        out += self._wide(np.frombuffer(joined, np.uint8), joined, self.at - len(self.last))
        self.last = chunk[-1:]
        self.at += len(chunk)
        return sorted(out)

    def _ascii(self, data: np.ndarray, raw: bytes) -> list:
        out = []
        begin, end = _stretches(PRINTABLE[data], 1)
        goes_on = len(begin) and begin[0] == 0
        if self.open_ascii or self.ascii_given:
            if goes_on:
                text = self.open_ascii + raw[:end[0]]
                made, self.open_ascii, self.ascii_given = self._give(
                    self.at + int(end[0]), text, self.ascii_given, False, bool(end[0] < len(raw)))
                out += made
                begin, end = begin[1:], end[1:]
            else:
                out += self._give(self.at, self.open_ascii, self.ascii_given, False, True)[0]
                self.open_ascii, self.ascii_given = b"", 0
        for b, e in zip(begin.tolist(), end.tolist()):
            made, rest, given = self._give(self.at + e, raw[b:e], 0, False, e < len(raw))
            out += made
            if e == len(raw):
                self.open_ascii, self.ascii_given = rest, given
        return out

    def _wide(self, data: np.ndarray, raw: bytes, base: int) -> list:
        out = []
        pair = PRINTABLE[data[:-1]] & (data[1:] == 0)
        for parity in (0, 1):
            shift = (parity - base) % 2  # the first place in ``raw`` with that parity in the file
            mask = pair[shift::2]
            if not len(mask):
                continue
            begin, end = _stretches(mask, 1)
            last = len(mask)

            def chars(b, e):
                return raw[shift + 2 * b:shift + 2 * e:2]

            if self.open_wide[parity] or self.wide_given[parity]:
                goes_on = len(begin) and begin[0] == 0
                e = int(end[0]) if goes_on else 0
                made, self.open_wide[parity], self.wide_given[parity] = self._give(
                    base + shift + 2 * e, self.open_wide[parity] + chars(0, e), self.wide_given[parity], True,
                    not goes_on or e < last)
                out += made
                if goes_on:
                    begin, end = begin[1:], end[1:]
            for b, e in zip(begin.tolist(), end.tolist()):
                made, rest, given = self._give(base + shift + 2 * e, chars(b, e), 0, True, e < last)
                out += made
                if e == last:
                    self.open_wide[parity], self.wide_given[parity] = rest, given
        return out

    def close(self) -> list[tuple[int, str, str]]:
        """The runs that the end of the file ends."""
        out = self._give(self.at, self.open_ascii, self.ascii_given, False, True)[0]
        for parity in (0, 1):
            # the last pair of this parity ends at the file's end or one byte before
            end = self.at - (self.at - parity) % 2
            out += self._give(end, self.open_wide[parity], self.wide_given[parity], True, True)[0]
        self.__init__(self.least, self.longest)
        return sorted(out)
