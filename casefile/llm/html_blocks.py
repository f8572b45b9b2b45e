"""HTML -> leaf blocks: the runs of text between block-level tags, with their tag paths."""

from __future__ import annotations

import html
import re

#: Tags that begin and end a block; all others stand inside one.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template title svg iframe object textarea head canvas".split())
#: Elements that hold raw text up to their own end tag.
RAW = frozenset("script style title textarea iframe noscript".split())
#: Skipped elements that lose no text behind them if they are never closed.
UNCLOSED = frozenset("template svg object canvas".split())
VOID = frozenset("hr".split())
#: An open element of the key's kind ends where one of the same group begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol menu dl table select html body div article section".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_BREAKOUT = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?=[\s/>])", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)
#: Block ancestors, from the leaf up, that a path names one by one; the names of those above come together, first.
PATH_DEPTH = 16


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id, role and itemprop."""
    out = [tag]
    if attributes:
        for found in _NAMES.finditer(attributes):
            out += ["." + w.lower() for w in _WORDS.findall(found[1] or found[2] or found[3] or "")]
        if _HIDDEN.search(attributes):
            out.append(".hidden")
    return tuple(dict.fromkeys(out))


def decode(text: str) -> str:
    """Character references -> characters."""
    if "&" not in text:
        return text
    if text.count("&") == text.count("&amp;"):
        return text.replace("&amp;", "&")
    return html.unescape(text)


def blocks(page: str) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """(path, text, characters inside links) of every leaf block with text, in page order."""
    out = []
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []  # tag, its names, all names down to it
    parts: list[str] = []
    linked = 0
    in_link = False
    at, end = 0, len(page)
    known: dict[tuple[str, str], tuple[str, ...]] = {}
    ends: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            above = (stack[-PATH_DEPTH - 1][2],) if len(stack) > PATH_DEPTH else ()
            out.append((above + tuple(n for _, n, _ in stack[-PATH_DEPTH:]), text, linked))
        parts.clear()
        linked = 0

    while at < end:
        found = _TAG.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            piece = decode(page[at:stop])
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        closing = found[1] or found[4]
        if tag in SKIPPED:
            if not closing and not (found[0].endswith("/>") and tag not in RAW):
                if tag in UNCLOSED:
                    if tag not in ends:
                        ends[tag] = _pairs(page, tag)
                    at = ends[tag].get(found.start()) or _unclosed(page, at, tag)
                else:
                    at = _past(page, at, tag)
            continue
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = not closing
            elif tag in ("br", "img", "input", "video", "audio", "wbr") and tag != "wbr":
                parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in _ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ENDS[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE and not (tag == "tr" and stack[k][0] != "table"):
                    break
        if tag in VOID:
            continue
        key = (tag, found[3] or found[6] or "")
        names = known.get(key)
        if names is None:
            names = known[key] = _names(*key)
        above = stack[-1][2] if stack else ()
        stack.append((tag, names, above + tuple(n for n in names if n not in above)))
    flush()
    return out


def _pairs(page: str, tag: str) -> dict[int, int]:
    """Where each element of a kind that is closed begins, and where it ends."""
    out, opened = {}, []
    for found in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page):
        if not found[1]:
            if not found[0].endswith("/>"):
                opened.append(found.start())
        elif opened:
            out[opened.pop()] = found.end()
    return out


def _unclosed(page: str, at: int, tag: str) -> int:
    """Where to go on after a start tag without an end tag: an svg ends at the next block tag, others at once."""
    block = _BREAKOUT.search(page, at) if tag == "svg" else None
    return block.start() if block else at


def _past(page: str, at: int, tag: str) -> int:
    """Where a skipped element ends; nested ones of its own kind are counted, except where text is raw."""
    depth = 1
    for found in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        if found[1]:
            depth -= 1
        elif tag not in RAW and not found[0].endswith("/>"):
            depth += 1
        if depth == 0:
            return found.end()
        if tag == "head" and depth > 1:
            depth = 1
    if tag == "head":  # never closed: the head ends where the body begins
        body = re.compile(r"<body\b", re.I).search(page, at)
        return body.start() if body else at
    return len(page)
