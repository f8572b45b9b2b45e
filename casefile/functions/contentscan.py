"""Verdicts about a content that comes in chunks: is it text, and what markup does it begin with.

These are the rules of ``functions.mediatype`` for files too large to load.  State between
chunks is a few bytes and counts, so chunk borders change nothing and memory stays
constant (of a root element's tag, ``TAG_BYTES`` are looked at).
"""

from __future__ import annotations

import codecs
import re

import numpy as np

# Bytes that text does not hold.
CONTROL = np.zeros(256, bool)
for _low, _high in ((0x00, 0x08), (0x0B, 0x0B), (0x0E, 0x1A), (0x1C, 0x1F)):
    CONTROL[_low:_high + 1] = True
#: Share of ASCII bytes from which bytes that are not UTF-8 may be text in a one-byte encoding, in percent.
ASCII_PERCENT = 90
#: Bytes kept of the tag of a root element.
TAG_BYTES = 1 << 16


class _Units:
    """Validity of UTF-16 or UTF-32, and how many of its units are ASCII."""

    def __init__(self, width: int, order: str):
        self.width, self.kind = width, np.dtype(f"{order}u{width}")
        self.rest, self.bad, self.high, self.units, self.ascii = b"", False, False, 0, 0

    def feed(self, chunk: bytes) -> None:
        if self.bad:
            return
        data = self.rest + chunk
        whole = len(data) - len(data) % self.width
        self.rest = data[whole:]
        units = np.frombuffer(data[:whole], self.kind)
        if not len(units):
            return
        surrogate = (units >= 0xD800) & (units < 0xE000)
        if self.width == 4:
            self.bad = bool((surrogate | (units > 0x10FFFF)).any())
        else:
            high = np.concatenate([[self.high], surrogate & (units < 0xDC00)])
            low = surrogate & (units >= 0xDC00)
            self.bad = bool((high[:-1] != low).any())  # each low one follows a high one, each high one is followed
            self.high = bool(high[-1])
        small = units < 256
        self.bad = self.bad or bool(CONTROL[units[small].astype(np.int64)].any())
        self.units += len(units)
        self.ascii += int((units < 128).sum())

    def valid(self, skipped: int = 0) -> bool:
        """Whether the whole is valid; without a mark (``skipped`` is 0) half of the units must be ASCII, too."""
        whole = not (self.bad or self.rest or self.high)
        return whole and (skipped > 0 or (self.units > 0 and 2 * self.ascii >= self.units))


# Marks at the beginning, and the encodings they stand for.
MARKS = [(b"\xff\xfe\x00\x00", "<4"), (b"\x00\x00\xfe\xff", ">4"), (b"\xff\xfe", "<2"), (b"\xfe\xff", ">2")]


class TextScanner:
    """Whether a content is text: UTF-8 or (mostly ASCII) one-byte text without control bytes, or UTF-16 or UTF-32."""

    def __init__(self):
        self.head, self.size, self.control, self.high, self.broken = b"", 0, False, 0, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")()
        self.units = {order + str(width): _Units(width, order) for order in "<>" for width in (2, 4)}

    def feed(self, chunk: bytes) -> None:
        if not chunk:
            return
        self.head += chunk[:4 - len(self.head)] if len(self.head) < 4 else b""
        self.size += len(chunk)
        data = np.frombuffer(chunk, np.uint8)
        self.control = self.control or bool(CONTROL[data].any())
        self.high += int((data >= 128).sum())
        if not self.broken:
            try:
                self.utf8.decode(chunk)
            except UnicodeDecodeError:
                self.broken = True
        for units in self.units.values():
            units.feed(chunk)

    def is_text(self) -> bool:
        """The verdict after the last chunk; an empty content is not text."""
        if not self.size:
            return False
        if self.head.startswith(b"\xef\xbb\xbf"):
            return True
        for mark, name in MARKS:
            if self.head.startswith(mark) and self.units[name].valid(len(mark)):
                return True
        if not self.control:
            broken = self.broken or bool(self.utf8.getstate()[0])
            return not broken or 100 * (self.size - self.high) >= ASCII_PERCENT * self.size
        return any(units.valid() for units in self.units.values())


# Namespaces that name a markup type.
SVG, XHTML, ATOM = "http://www.w3.org/2000/svg", "http://www.w3.org/1999/xhtml", "http://www.w3.org/2005/Atom"
#: Root elements of pages.
PAGE_ROOTS = ("html", "head", "body", "title", "script")


def markup_type(declared: bool, page: bool, root: str | None, attributes: str) -> str | None:
    """The type of markup: whether it has an XML declaration, a doctype of a page, its root element's name (local,
    lower case) and the rest of that tag."""
    if root == "svg" and (SVG in attributes or not declared):
        return "image/svg+xml"
    if root == "html" and XHTML in attributes:
        return "application/xhtml+xml"
    if root == "rss":
        return "application/rss+xml"
    if root == "feed" and ATOM in attributes:
        return "application/atom+xml"
    if declared:
        return "application/xml"
    if page or root in PAGE_ROOTS:
        return "text/html"
    if root and "xmlns" in attributes:
        return "application/xml"
    return None


_ROOT = re.compile(rb"<((?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*)([^>]*)", re.S)
_BLANKS = re.compile(rb"[\t\n\r\f ]*")
_DECLARATION = re.compile(rb"<\?xml(?![\w.:-])", re.I)
_PAGE = re.compile(rb"<!doctype[\t\n\r\f ]+html(?![\w.:-])", re.I)
_TURN = re.compile(rb"[>\[]")


class PrologScanner:
    """What stands before a markup's root element, of any length, and the root's tag."""

    def __init__(self):
        self.held, self.at = b"", 0  # bytes not judged yet begin at ``at``
        self.inside: bytes | None = None  # what ends the comment, instruction or inner part of a doctype at ``at``
        self.first = self.at_start = True
        self.declared = self.page = self.done = False
        self.tag = b""

    def feed(self, chunk: bytes) -> None:
        if self.done:
            return
        self.held, self.at = self.held[self.at:] + chunk, 0
        while self._step(False):
            pass

    def _step(self, last: bool) -> bool:
        """Judge one item; false when more bytes are needed, or all is known."""
        held = self.held
        if self.done:
            return False
        if self.inside:
            found = held.find(self.inside, self.at)
            if found < 0:
                self.at = max(self.at, len(held) - len(self.inside) + 1)  # the end may have begun
                return False
            self.at = found + len(self.inside)
            self.inside = b">" if self.inside == b"]" else None
            return True
        if self.first:
            if len(held) < 3 and not last:
                return False
            self.first = False
            if held.startswith(b"\xef\xbb\xbf"):
                self.at = 3
        self.at = _BLANKS.match(held, self.at).end()
        left = len(held) - self.at
        if not left:
            return False
        if held[self.at:self.at + 1] != b"<":
            self.done = True
            return False
        if left < 9 and not last:
            return False
        low = held[self.at:self.at + 9].lower()
        if low.startswith(b"<?"):
            self.declared = self.declared or (self.at_start and bool(_DECLARATION.match(held, self.at)))
            self.at_start, self.inside = False, b"?>"
            self.at += 2
            return True
        self.at_start = False
        if low.startswith(b"<!--"):
            self.inside = b"-->"
            self.at += 4
            return True
        if low == b"<!doctype":
            end = _TURN.search(held, self.at)
            if end is None and not last and left < TAG_BYTES:
                return False
            self.page = self.page or bool(_PAGE.match(held, self.at))
            if end is None:
                self.done = True
                return False
            self.inside = b"]" if end[0] == b"[" else None
            self.at = end.end()
            return True
        close = held.find(b">", self.at)
        if close < 0 and not last and left < TAG_BYTES:
            return False
        self.tag = held[self.at:min(self.at + TAG_BYTES, len(held) if close < 0 else close)]
        self.done = True
        return False

    def verdict(self) -> str | None:
        """The markup type after the last chunk, or None."""
        while self._step(True):
            pass
        found = _ROOT.match(self.tag)
        root = found[1].split(b":")[-1].decode().lower() if found else None
        return markup_type(self.declared, self.page, root, found[2].decode("latin-1") if found else "")
