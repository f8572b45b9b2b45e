"""Media-type detection compiled to native column expressions.

Detection works in three steps, all evaluated by Spark's codegen (no per-row
Python):

1. *Magic*: ordered signature rules at fixed offsets in the first
   ``HEAD_BYTES`` bytes; a rule is a list of ``(offset, bytes)`` conditions
   that must all hold.  Markup is told by its root element's name and namespace;
   a byte-order mark, blanks, comments, instructions and a doctype before it may
   have any length.
2. *Text fallback*: no magic hit -> ``text/plain`` if the whole content is text,
   else ``application/octet-stream``.  Text is UTF-8 without control bytes
   (0x00-0x08, 0x0B, 0x0E-0x1A, 0x1C-0x1F); other bytes without control bytes
   that are mostly ASCII; UTF-16 or UTF-32 that is valid throughout and either
   has its mark or is at least half ASCII.  A UTF-8 mark makes text.  Empty
   content -> octet-stream.  The content is only searched where no rule of step 1 holds.
3. *Name refinement*: the extension of the last path segment names a
   candidate type; it replaces the content verdict only when it is the same
   type or a declared specialisation of it (``.docx`` refines a zip,
   ``.json`` refines plain text).  A contradicting name keeps the content
   verdict; anything specialises ``application/octet-stream``.

``functions.contentscan`` has the same rules for contents that come in chunks.
The signatures come from the public format specifications of each format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casefile.functions import contentscan
from casefile.functions.columns import extension

HEAD_BYTES = 512
OCTET_STREAM = "application/octet-stream"
TEXT_PLAIN = "text/plain"

# Byte signatures from public format specs.
# SIGNATURES are leading bytes (offset 0).  They are prefix-free (checked
# below), so at most one can match and their order does not matter.
SIGNATURES: list[tuple[str, str]] = [
    ("image/png", "89504E470D0A1A0A"),
    ("image/jpeg", "FFD8FF"),
    ("image/gif", "474946383761"),
    ("image/gif", "474946383961"),
    ("image/tiff", "49492A00"),
    ("image/tiff", "4D4D002A"),
    ("application/pdf", "255044462D"),
    ("application/postscript", "252150532D"),
    ("application/rtf", "7B5C72746631"),
    ("application/x-tika-msoffice", "D0CF11E0A1B11AE1"),
    ("application/zip", "504B0304"),
    ("application/zip", "504B0506"),
    ("application/zip", "504B0708"),
    ("application/gzip", "1F8B"),
    ("application/x-bzip2", "425A68"),
    ("application/x-xz", "FD377A585A00"),
    ("application/zstd", "28B52FFD"),
    ("application/x-7z-compressed", "377ABCAF271C"),
    ("application/x-rar-compressed", "526172211A07"),
    ("application/x-executable", "7F454C46"),
    ("application/x-msdownload", "4D5A"),
    ("application/java-vm", "CAFEBABE"),
    ("application/x-sqlite3", "53514C69746520666F726D6174203300"),
    ("application/ogg", "4F676753"),
    ("audio/x-flac", "664C6143"),
    ("audio/mpeg", "494433"),
    ("video/mpeg", "000001BA"),
    ("video/mpeg", "000001B3"),
]

# Containers, tested after SIGNATURES: a signature at an offset, and the brand in four bytes
# at another, which names the type (or else the container's own type, if it has one).
CONTAINERS: list[tuple[int, str, int, dict[str, str], str | None]] = [
    (4, "66747970", 8, {"71742020": "video/quicktime", "68656963": "image/heic", "68656978": "image/heic",
                        "6D696631": "image/heif", "4D344120": "audio/mp4"}, "video/mp4"),
    (0, "52494646", 8, {"57454250": "image/webp", "57415645": "audio/vnd.wave", "41564920": "video/x-msvideo"}, None),
    (0, "424D", 6, {"00000000": "image/bmp"}, None),
    (257, "7573746172", 0, {}, "application/x-tar"),
]

# File-name extension -> media type.
EXTENSION_TYPES: dict[str, str] = {
    "txt": "text/plain", "text": "text/plain", "log": "text/x-log", "csv": "text/csv",
    "tsv": "text/tab-separated-values", "md": "text/x-web-markdown", "css": "text/css",
    "htm": "text/html", "html": "text/html", "xhtml": "application/xhtml+xml",
    "xml": "application/xml", "svg": "image/svg+xml", "rss": "application/rss+xml",
    "atom": "application/atom+xml",
    "json": "application/json", "js": "application/javascript", "sh": "application/x-sh",
    "py": "text/x-python", "java": "text/x-java-source", "c": "text/x-csrc", "h": "text/x-chdr",
    "sql": "text/x-sql", "ini": "text/x-ini", "yaml": "text/x-yaml", "yml": "text/x-yaml",
    "rtf": "application/rtf", "pdf": "application/pdf", "ps": "application/postscript",
    "eps": "application/postscript",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp",
    "ico": "image/vnd.microsoft.icon",
    "wav": "audio/vnd.wave", "avi": "video/x-msvideo", "mp3": "audio/mpeg", "flac": "audio/x-flac",
    "ogg": "audio/vorbis", "oga": "audio/vorbis", "ogv": "video/ogg", "mp4": "video/mp4",
    "m4v": "video/x-m4v", "mpg": "video/mpeg", "mpeg": "video/mpeg",
    "zip": "application/zip", "gz": "application/gzip", "tgz": "application/gzip",
    "bz2": "application/x-bzip2", "xz": "application/x-xz", "zst": "application/zstd",
    "7z": "application/x-7z-compressed", "rar": "application/x-rar-compressed",
    "tar": "application/x-tar",
    "jar": "application/java-archive", "apk": "application/vnd.android.package-archive",
    "epub": "application/epub+zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "doc": "application/msword", "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint", "msg": "application/vnd.ms-outlook",
    "exe": "application/x-msdownload", "dll": "application/x-msdownload",
    "class": "application/java-vm", "so": "application/x-sharedlib",
    "sqlite": "application/x-sqlite3", "db": "application/x-sqlite3",
}

# Type hierarchy, child -> parent.  Every type is implicitly a
# specialisation of application/octet-stream.
PARENT_TYPES: dict[str, str] = {
    "text/html": "text/plain", "text/csv": "text/plain", "text/css": "text/plain",
    "text/tab-separated-values": "text/plain", "text/x-web-markdown": "text/plain",
    "text/x-log": "text/plain", "text/x-python": "text/plain", "text/x-java-source": "text/plain",
    "text/x-csrc": "text/plain", "text/x-chdr": "text/x-csrc", "text/x-sql": "text/plain",
    "text/x-ini": "text/plain", "text/x-yaml": "text/plain",
    "application/javascript": "text/plain", "application/json": "application/javascript",
    "application/x-sh": "text/plain", "application/xml": "text/plain",
    "image/svg+xml": "application/xml", "application/xhtml+xml": "application/xml",
    "application/rss+xml": "application/xml", "application/atom+xml": "application/xml",
    "application/postscript": "text/plain",
    "application/x-tika-ooxml": "application/zip",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "application/x-tika-ooxml",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "application/x-tika-ooxml",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "application/x-tika-ooxml",
    "application/vnd.oasis.opendocument.text": "application/zip",
    "application/vnd.oasis.opendocument.spreadsheet": "application/zip",
    "application/vnd.oasis.opendocument.presentation": "application/zip",
    "application/java-archive": "application/zip",
    "application/vnd.android.package-archive": "application/java-archive",
    "application/epub+zip": "application/zip",
    "application/msword": "application/x-tika-msoffice",
    "application/vnd.ms-excel": "application/x-tika-msoffice",
    "application/vnd.ms-powerpoint": "application/x-tika-msoffice",
    "application/vnd.ms-outlook": "application/x-tika-msoffice",
    "audio/vorbis": "application/ogg", "video/ogg": "application/ogg",
    "video/x-m4v": "video/mp4", "application/x-sharedlib": "application/x-executable",
}


def _check_prefix_free() -> None:
    sigs = [h.upper() for _, h in SIGNATURES]
    for i, x in enumerate(sigs):
        for j, y in enumerate(sigs):
            if i != j and y.startswith(x):
                raise ValueError(f"signature {x} is a prefix of {y}")


_check_prefix_free()

# Bytes counted as "control" by the text fallback.
CONTROL_BYTES = [(0x00, 0x08), (0x0B, 0x0B), (0x0E, 0x1A), (0x1C, 0x1F)]
BLANKS = r"\t\n\r\f "


def ancestors(media_type: str) -> list[str]:
    """The type itself, its declared supertypes, then octet-stream."""
    chain, seen = [media_type], {media_type}
    while chain[-1] in PARENT_TYPES and PARENT_TYPES[chain[-1]] not in seen:
        chain.append(PARENT_TYPES[chain[-1]])
        seen.add(chain[-1])
    if OCTET_STREAM not in seen:
        chain.append(OCTET_STREAM)
    return chain


def known_types() -> list[str]:
    """Every type that a rule, an extension or the hierarchy names."""
    named = {t for t, _ in SIGNATURES} | {t for t in MARKUP_TYPES} | set(EXTENSION_TYPES.values())
    named |= {t for *_, brands, other in CONTAINERS for t in (*brands.values(), other) if t}
    return sorted(named | set(PARENT_TYPES) | set(PARENT_TYPES.values()) | {TEXT_PLAIN, OCTET_STREAM})


def _ancestor_text(media_type: str) -> str:
    return "|" + "|".join(ancestors(media_type)) + "|"


def _bytes_at(head: Column, offset: int, hex_bytes: str) -> Column:
    raw = bytes.fromhex(hex_bytes)
    if offset == 0:
        return head.startswith(F.lit(raw))
    return F.substring(head, offset + 1, len(raw)) == F.lit(raw)


SIGNATURE_HEX_CHARS = 2 * max(len(h) // 2 for _, h in SIGNATURES)


_LITERALS: dict[tuple[str, str], Column] = {}


def _literal(name: str, build) -> Column:
    """A literal lookup table as a Column, built once per SparkContext.

    The tables hold a few hundred literals; building them costs one py4j
    call per literal, so they are reused across queries (Columns are
    immutable expressions).
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = (sc.applicationId if sc is not None else "", name)
    if key not in _LITERALS:
        _LITERALS[key] = build()
    return _LITERALS[key]


def head_of(content: Column) -> Column:
    """The bytes the rules look at."""
    return F.substring(content, 1, HEAD_BYTES)


def _signature_type(head_hex: Column) -> Column:
    """Leading-signature verdict: one literal-map lookup per signature length."""
    by_length: dict[int, list[tuple[str, str]]] = {}
    for media_type, hex_bytes in SIGNATURES:
        by_length.setdefault(len(hex_bytes), []).append((hex_bytes.upper(), media_type))
    lookups = []
    for n_chars, entries in sorted(by_length.items()):
        table = _literal(f"signatures{n_chars}",
                         lambda e=entries: F.create_map(*[F.lit(x) for kv in sorted(e) for x in kv]))
        lookups.append(F.element_at(table, F.substring(head_hex, 1, n_chars)))
    return F.coalesce(*lookups)


def _container_type(head: Column) -> Column:
    """Container verdict: one test per container, one literal-map lookup for its brands."""
    verdicts = []
    for offset, signature, brand_at, brands, otherwise in CONTAINERS:
        found = F.lit(otherwise).cast("string")
        if brands:
            table = _literal(f"brands{offset}{signature}",
                             lambda e=brands: F.create_map(*[F.lit(x) for kv in sorted(e.items()) for x in kv]))
            found = F.coalesce(F.element_at(table, F.hex(F.substring(head, brand_at + 1, 4))), found)
        verdicts.append(F.when(_bytes_at(head, offset, signature), found))
    return F.coalesce(*verdicts)


# Patterns over content as ISO-8859-1 text.  ``SKIPPED`` is one item before a root element; ``\G`` takes
# item after item from the beginning, however many there are.
MARK = r"\A\xEF\xBB\xBF"
MAY_BE_MARKUP = rf"\A(?:\xEF\xBB\xBF)?[{BLANKS}]*+(?:<|\z)"
DECLARATION = rf"(?i)\A(?:\xEF\xBB\xBF)?[{BLANKS}]*+<\?xml(?![\w.:-])"
SKIPPED = (rf"(?is)\G(?:{MARK}|[{BLANKS}]++|<!--.*?-->|<\?.*?\?>|<!doctype[^>\[]*+(?:>|\[.*?\].*?>))")
COMMENTS = r"(?s)<!--.*?-->|<\?.*?\?>"
PAGE = rf"(?i)<!doctype[{BLANKS}]+html(?![\w.:-])"
ROOT = r"(?s)\A<(?:[A-Za-z_][\w.-]*+:)?+([A-Za-z_][\w.-]*+)([^>]*+)"
MARKUP_TYPES = ("image/svg+xml", "application/xhtml+xml", "application/rss+xml", "application/atom+xml",
                "application/xml", "text/html")


def iso_text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def markup_text(content: Column, head_text: Column) -> Column:
    """The whole content as text where its head may begin markup, else NULL."""
    return F.when(head_text.rlike(MAY_BE_MARKUP), iso_text(content))


def markup_type(text: Column, rest: Column) -> Column:
    """The markup type of a content's ``text``, of which ``rest`` is left after the items before the root; or NULL."""
    before = F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(rest)), COMMENTS, "")
    tag = F.substring(rest, 1, contentscan.TAG_BYTES)
    root, attributes = F.lower(F.regexp_extract(tag, ROOT, 1)), F.regexp_extract(tag, ROOT, 2)
    declared = text.rlike(DECLARATION)
    page = before.rlike(PAGE) | rest.rlike(r"\A" + PAGE)
    return (F.when((root == "svg") & (F.contains(attributes, F.lit(contentscan.SVG)) | ~declared), "image/svg+xml")
            .when((root == "html") & F.contains(attributes, F.lit(contentscan.XHTML)), "application/xhtml+xml")
            .when(root == "rss", "application/rss+xml")
            .when((root == "feed") & F.contains(attributes, F.lit(contentscan.ATOM)), "application/atom+xml")
            .when(declared, "application/xml")
            .when(page | root.isin(*contentscan.PAGE_ROOTS), "text/html")
            .when((root != "") & F.contains(attributes, F.lit("xmlns")), "application/xml"))


def _without_items(text: Column) -> Column:
    return F.regexp_replace(text, SKIPPED, "")


# What a unit of text may be, as ISO-8859-1 patterns: an ASCII character that is no control byte, any
# byte, and the second byte of any other character but a surrogate.
_ASCII = r"[\x09\x0A\x0C\x0D\x1B\x20-\x7F]"
_ANY, _HIGH = r"[\x00-\xFF]", r"[\x01-\xD7\xE0-\xFF]"


def _unit_patterns(width: int, big: bool) -> tuple[str, str]:
    """Patterns of an ASCII unit, and of any other valid unit (or pair), in one byte order."""
    def unit(*high_to_low: str) -> str:
        zeros = [r"\x00"] * (width - len(high_to_low))
        order = [*zeros, *high_to_low]
        return "".join(order if big else reversed(order))

    others = [unit(r"[\x80-\xFF]"), unit(_HIGH, _ANY)]
    if width == 2:
        others.append(unit(r"[\xD8-\xDB]", _ANY) + unit(r"[\xDC-\xDF]", _ANY))
    else:
        others.append(unit(r"[\x01-\x10]", _ANY, _ANY))
    return unit(f"({_ASCII})"), "|".join(others)


def _valid_units(text: Column, width: int, big: bool, marked: bool) -> Column:
    """Whether all of ``text`` is valid UTF-16 or UTF-32 without control characters; unmarked, half of it ASCII."""
    ascii_unit, other = _unit_patterns(width, big)
    # each step of ``\G`` takes one unit, up to the first that is not valid
    each = rf"(?s)\G(?:{ascii_unit}|{other})"
    valid = F.regexp_replace(text, each, "") == ""
    if marked:
        return valid
    n_ascii = F.length(F.regexp_replace(text, each, "$1"))  # of a valid text, the ASCII characters are left
    return valid & (F.length(text) > 0) & (2 * width * n_ascii >= F.length(text))


def _holds_control(content: Column) -> Column:
    found = [F.contains(content, F.lit(bytes([b]))) for low, high in CONTROL_BYTES for b in range(low, high + 1)]
    return reduce(Column.__or__, found)


def is_text(content: Column, text: Column | None = None) -> Column:
    """Whether the whole content is text (step 2); costly tests run only where cheap ones leave it open."""
    text = iso_text(content) if text is None else text
    verdict = F.when(F.octet_length(content) == 0, False).when(content.startswith(F.lit(b"\xef\xbb\xbf")), True)
    wide = F.lit(False)
    for mark, name in contentscan.MARKS:
        wide = wide | (content.startswith(F.lit(mark)) & _valid_units(text, int(name[1]), name[0] == ">", True))
    for _, name in contentscan.MARKS:
        wide = wide | ((F.octet_length(content) % int(name[1]) == 0) & _valid_units(text, int(name[1]), name[0] == ">", False))
    mostly = 100 * F.length(F.regexp_replace(text, r"[\x80-\xFF]+", "")) >= contentscan.ASCII_PERCENT * F.length(text)
    marked = content.startswith(F.lit(b"\xff\xfe")) | content.startswith(F.lit(b"\xfe\xff"))
    return (verdict.when(_holds_control(content), wide)
            .when(F.is_valid_utf8(content.cast("string")), True)
            .when(marked, mostly | wide).otherwise(mostly))


def type_of_head(head: Column, markup: Column, text_like: Column, head_hex: Column | None = None) -> Column:
    """Content verdict (steps 1, 2) from the projected head, the markup type, whether the whole content is text
    (evaluated only where no rule holds) and (optionally) the head's upper-case hex."""
    if head_hex is None:
        head_hex = F.hex(F.substring(head, 1, SIGNATURE_HEX_CHARS // 2))
    fallback = F.when(text_like, F.lit(TEXT_PLAIN)).otherwise(F.lit(OCTET_STREAM))
    return F.when(head.isNotNull(), F.coalesce(_signature_type(head_hex), _container_type(head), markup, fallback))


def magic_type(content: Column) -> Column:
    """Content-only verdict as one expression (see ``with_content_type``)."""
    head = head_of(content)
    text = markup_text(content, iso_text(head))
    return type_of_head(head, markup_type(text, _without_items(text)), is_text(content))


def name_type(path: Column) -> Column:
    """Media type named by the extension of the last path segment, or NULL."""
    table = _literal("extensions", lambda: F.create_map(
        *[F.lit(x) for kv in sorted(EXTENSION_TYPES.items()) for x in kv]))
    return F.element_at(table, extension(path))


def _lineage_map() -> Column:
    return _literal("lineage", lambda: F.create_map(
        *[F.lit(x) for t in sorted(set(EXTENSION_TYPES.values())) for x in (t, _ancestor_text(t))]))


def refine(content_type: Column, candidate: Column) -> Column:
    """Accept ``candidate`` only if it equals or specialises ``content_type``."""
    accepted = F.instr(F.element_at(_lineage_map(), candidate),
                       F.concat(F.lit("|"), content_type, F.lit("|"))) > 0
    return F.when(content_type.isNotNull(),
                  F.when(candidate.isNotNull() & accepted, candidate).otherwise(content_type))


def detect(content: Column, path: Column | None = None) -> Column:
    """Media type of ``content``, refined by the file name in ``path`` if given.

    Single-expression form; operators use the staged ``with_content_type`` /
    ``with_media_type``, which keep the generated code small.
    """
    verdict = magic_type(content)
    return verdict if path is None else refine(verdict, name_type(path))


def refine_by_name(content_type: Column, path: Column) -> Column:
    """Refine an already computed content verdict with a file name."""
    return refine(content_type, name_type(path))


_TMP = "__casefile_"


def _columns_except(df: DataFrame, name: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c != name]


def with_content_type(df: DataFrame, content: str, out: str = "content_type") -> DataFrame:
    """Add the content-only verdict of binary column ``content`` as ``out``.

    The head, and the text of what may be markup, are projected first; the rule CASE then reads
    those columns once each instead of re-slicing the content per rule.
    """
    whole, head, text, rest = (_TMP + n for n in ("whole", "head", "text", "rest"))
    keep = _columns_except(df, out)
    staged = df.select(*keep, F.col(content).alias(whole), head_of(F.col(content)).alias(head))
    staged = staged.withColumn(text, markup_text(F.col(whole), iso_text(F.col(head))))
    staged = staged.withColumn(rest, _without_items(F.col(text)))
    return with_head_type(staged, head, markup_type(F.col(text), F.col(rest)), is_text(F.col(whole)), out) \
        .drop(whole, head, text, rest)


def with_head_type(df: DataFrame, head: str, markup: Column, text_like: Column, out: str = "content_type") -> DataFrame:
    """Add ``out``: the verdict from a column with the first ``HEAD_BYTES`` bytes, from the markup type, and from
    whether the whole content is text."""
    hexed = _TMP + "hex"
    keep = _columns_except(df, out)
    staged = df.select(*keep, F.hex(F.substring(F.col(head), 1, SIGNATURE_HEX_CHARS // 2)).alias(hexed))
    return staged.select(*keep, type_of_head(F.col(head), markup, text_like, F.col(hexed)).alias(out))


def with_media_type(df: DataFrame, content_type: str, path: Column | str,
                    out: str = "media_type") -> DataFrame:
    """Add ``out`` = ``content_type`` refined by the file name in ``path``."""
    cand = _TMP + "candidate"
    path_col = F.col(path) if isinstance(path, str) else path
    keep = _columns_except(df, out)
    staged = df.select(*keep, name_type(path_col).alias(cand))
    return staged.select(*keep, refine(F.col(content_type), F.col(cand)).alias(out))
