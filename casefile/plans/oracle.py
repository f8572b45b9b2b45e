"""DuckDB SQL for the evidence derivation, used as an independent oracle.

``EVIDENCE_CTE`` mirrors ``casefile.sources.testdata`` in plain SQL over the
generated tables.  It defines:

* ``ev``    — evidence rows (``inline_text`` = inline content as text,
              ``file_content`` = the same as BLOB, ``t`` = full text)
* ``ext``   — the external store ``(path, id, length, content, t)``
* ``files`` — every content-bearing file with its text ``t`` and label,
              i.e. what the hashing job covers (inline non-empty + external)

DuckDB has no SHA-512, so oracle queries that group by digest group by the
content text itself (equal bytes <=> equal digest), and queries that print a
digest use the SHA-256 variant of the same Spark code path.

Nothing is imported from the code under test: layout, signatures, extensions
and the type hierarchy are written out here by hand.  The tables hold text, so
only signatures that are valid UTF-8 can occur; the others are in pytest.
"""

from __future__ import annotations

INLINE_LIMIT = 4096
EXTERNAL_DIR = "/external/"

# What chat turns 0, 1, 2 ... of every 40 begin with.
_PREFIX_SQL = """CASE (conv_id + turn) % 40
  WHEN 0 THEN '%PDF-1.7' || chr(10) WHEN 1 THEN 'GIF89a' WHEN 2 THEN 'PK' || chr(3) || chr(4) WHEN 3 THEN '%!PS-Adobe'
  WHEN 4 THEN '{' || chr(92) || 'rtf1 ' WHEN 5 THEN 'BZh9' WHEN 6 THEN 'Rar!' || chr(26) || chr(7)
  WHEN 7 THEN chr(127) || 'ELF' WHEN 8 THEN 'MZ' WHEN 9 THEN 'SQLite format 3' || chr(0) WHEN 10 THEN 'OggS'
  WHEN 11 THEN 'fLaC' WHEN 12 THEN 'ID3' WHEN 13 THEN 'RIFF0000WEBP' WHEN 14 THEN 'RIFF0000WAVE'
  WHEN 15 THEN 'RIFF0000AVI ' WHEN 16 THEN '0000ftypqt  ' WHEN 17 THEN '0000ftypheic' WHEN 18 THEN '0000ftypM4A '
  WHEN 19 THEN '0000ftypisom' WHEN 20 THEN 'II*' || chr(0) WHEN 21 THEN 'BM0000' || repeat(chr(0), 4)
  WHEN 22 THEN '<?xml version="1.0"?>' WHEN 23 THEN ' ' || chr(10) || '<SVG ' WHEN 24 THEN chr(65279) || '<html>'
  WHEN 25 THEN chr(65279) WHEN 26 THEN repeat('x', 600) || chr(0) WHEN 27 THEN repeat('y', 257) || 'ustar'
  WHEN 28 THEN regexp_replace('Secret wide text ', '(.)', chr(92) || '1' || chr(0), 'g') || chr(0) || chr(0)
  WHEN 29 THEN repeat(' ', 600) || '<html>' WHEN 30 THEN '<!-- ' || repeat('c', 2000) || ' -->' || chr(10) || '<svg '
  WHEN 31 THEN '<?xml version="1.0"?><!-- a --><rss version="2.0">'
  WHEN 32 THEN '<html xmlns="http://www.w3.org/1999/xhtml">' WHEN 33 THEN '<feed xmlns="http://www.w3.org/2005/Atom">'
  ELSE '' END"""

EVIDENCE_CTE = f"""
WITH f AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id,
         source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)
           || CASE doc_id % 7 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' ELSE '.txt' END AS file_path,
         'DATA_FILE' AS file_type, lang AS owner, source AS grp, text AS t
  FROM documents
  UNION ALL
  SELECT 'page-' || CAST(page_id AS VARCHAR),
         'web/' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 10 = 0 THEN '.txt' ELSE '.html' END,
         'DATA_FILE', 'web', 'web', html
  FROM pages
  UNION ALL
  SELECT 'evt-' || CAST(event_id AS VARCHAR),
         CASE WHEN event_id % 50 = 0 THEN CAST(NULL AS VARCHAR)
              ELSE 'events/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.json' END,
         'DATA_FILE', CAST(user_id AS VARCHAR), event_type,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE props END
  FROM events
  UNION ALL
  SELECT 'chat-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR),
         'chat/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt',
         'DATA_FILE', role, 'chat',
         CASE WHEN (conv_id + turn) % 40 = 34 AND regexp_matches(text, '^[\\x00-\\x7F]*$')
              THEN regexp_replace(text, '(.)', chr(92) || '1' || chr(0), 'gs') ELSE ({_PREFIX_SQL}) || text END
  FROM conversations
  UNION ALL
  SELECT 'dir-' || CAST(r_regionkey AS VARCHAR), r_name, 'DIRECTORY', 'root', 'root', CAST(NULL AS VARCHAR)
  FROM region
),
f2 AS (SELECT *, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes FROM f),
ev AS (
  SELECT id, file_path, file_type, CAST(n_bytes AS VARCHAR) AS file_size, owner, grp AS "group",
         CAST(NULL AS VARCHAR) AS permissions, CAST(NULL AS VARCHAR) AS last_modified,
         CAST(NULL AS VARCHAR) AS last_changed, CAST(NULL AS VARCHAR) AS last_accessed,
         CAST(NULL AS VARCHAR) AS created,
         CASE WHEN n_bytes > {INLINE_LIMIT} THEN '{EXTERNAL_DIR}' || id END AS external_path,
         CASE WHEN n_bytes <= {INLINE_LIMIT} THEN encode(t) END AS file_content,
         CASE WHEN n_bytes <= {INLINE_LIMIT} THEN t END AS inline_text,
         t, n_bytes
  FROM f2
),
ext AS (
  SELECT '{EXTERNAL_DIR}' || id AS path, id, n_bytes AS length, encode(t) AS content, t
  FROM ev WHERE n_bytes > {INLINE_LIMIT}
),
stored AS (
  SELECT path, id, length, t FROM ext
  UNION ALL
  SELECT '{EXTERNAL_DIR}again/' || id, id, length + 1, t || '!' FROM ext WHERE length % 5 = 0
),
files AS (
  SELECT id, file_path, inline_text AS t, file_content AS content,
         id || '_' || coalesce(file_path, 'null') AS label
  FROM ev WHERE file_content IS NOT NULL AND octet_length(file_content) > 0
  UNION ALL
  SELECT e.id, e.file_path, x.t, x.content, e.id || '_' || coalesce(e.file_path, 'null') AS label
  FROM ext x JOIN ev e ON e.id = x.id
)
"""


def with_evidence(body: str) -> str:
    """Prefix a query body with the evidence CTE (extra CTEs start with ``,``)."""
    return EVIDENCE_CTE + body


def content_type_sql(t: str) -> str:
    """Content verdict of a text.  Markup is told by its root element, after a byte-order mark, white space, comments,
    instructions and a doctype; RE2's ``^`` and ``$`` are the text's ends."""
    blank = r"[\t\n\r\f ]"
    item = rf"(?:{blank}+|<!--.*?-->|<\?.*?\?>)"
    bare = f"ltrim({t}, chr(65279))"
    rest = f"regexp_replace({bare}, '^(?:{item}|<!doctype[^>]*>)*', '', 'is')"
    root = f"lower(regexp_extract({rest}, '^<([A-Za-z_][A-Za-z_0-9.-]*)', 1))"
    tag = f"regexp_extract({rest}, '^<[^>]*', 0)"
    declared = f"regexp_matches({bare}, '^{blank}*<\\?xml[ ?]')"
    return f"""CASE WHEN {t} IS NULL THEN NULL
      WHEN starts_with({t}, '%PDF-') THEN 'application/pdf'
      WHEN starts_with({t}, 'GIF87a') OR starts_with({t}, 'GIF89a') THEN 'image/gif'
      WHEN starts_with({t}, 'II*' || chr(0)) OR starts_with({t}, 'MM' || chr(0) || '*') THEN 'image/tiff'
      WHEN starts_with({t}, '%!PS-') THEN 'application/postscript'
      WHEN starts_with({t}, '{{' || chr(92) || 'rtf1') THEN 'application/rtf'
      WHEN left({t}, 4) IN ('PK' || chr(3) || chr(4), 'PK' || chr(5) || chr(6), 'PK' || chr(7) || chr(8))
        THEN 'application/zip'
      WHEN starts_with({t}, 'BZh') THEN 'application/x-bzip2'
      WHEN starts_with({t}, 'Rar!' || chr(26) || chr(7)) THEN 'application/x-rar-compressed'
      WHEN starts_with({t}, chr(127) || 'ELF') THEN 'application/x-executable'
      WHEN starts_with({t}, 'MZ') THEN 'application/x-msdownload'
      WHEN starts_with({t}, 'SQLite format 3' || chr(0)) THEN 'application/x-sqlite3'
      WHEN starts_with({t}, 'OggS') THEN 'application/ogg'
      WHEN starts_with({t}, 'fLaC') THEN 'audio/x-flac'
      WHEN starts_with({t}, 'ID3') THEN 'audio/mpeg'
      WHEN starts_with({t}, 'BM') AND substr({t}, 7, 4) = repeat(chr(0), 4) THEN 'image/bmp'
      WHEN starts_with({t}, 'RIFF') AND substr({t}, 9, 4) = 'WEBP' THEN 'image/webp'
      WHEN starts_with({t}, 'RIFF') AND substr({t}, 9, 4) = 'WAVE' THEN 'audio/vnd.wave'
      WHEN starts_with({t}, 'RIFF') AND substr({t}, 9, 4) = 'AVI ' THEN 'video/x-msvideo'
      WHEN substr({t}, 5, 8) = 'ftypqt  ' THEN 'video/quicktime'
      WHEN substr({t}, 5, 8) IN ('ftypheic', 'ftypheix') THEN 'image/heic'
      WHEN substr({t}, 5, 8) = 'ftypmif1' THEN 'image/heif'
      WHEN substr({t}, 5, 8) = 'ftypM4A ' THEN 'audio/mp4'
      WHEN substr({t}, 5, 4) = 'ftyp' THEN 'video/mp4'
      WHEN substr({t}, 258, 5) = 'ustar' THEN 'application/x-tar'
      WHEN {root} = 'svg' AND (NOT {declared} OR contains({tag}, 'http://www.w3.org/2000/svg')) THEN 'image/svg+xml'
      WHEN {root} = 'html' AND contains({tag}, 'http://www.w3.org/1999/xhtml') THEN 'application/xhtml+xml'
      WHEN {root} = 'rss' THEN 'application/rss+xml'
      WHEN {root} = 'feed' AND contains({tag}, 'http://www.w3.org/2005/Atom') THEN 'application/atom+xml'
      WHEN {declared} THEN 'application/xml'
      WHEN regexp_matches({bare}, '^{item}*<!doctype{blank}+html', 'is') THEN 'text/html'
      WHEN {root} IN ('html', 'head', 'body', 'title', 'script') THEN 'text/html'
      WHEN {root} <> '' AND contains({tag}, 'xmlns') THEN 'application/xml'
      WHEN starts_with({t}, chr(65279)) THEN 'text/plain'
      WHEN {t} = '' THEN 'application/octet-stream'
      WHEN regexp_matches({t}, '^([\\x09\\x0A\\x0C\\x0D\\x1B\\x20-\\x7F]\\x00)+$') THEN 'text/plain'
      WHEN regexp_matches({t}, '[\\x00-\\x08\\x0B\\x0E-\\x1A\\x1C-\\x1F]') THEN 'application/octet-stream'
      ELSE 'text/plain' END"""


def refine_sql(content_type: str, path: str) -> str:
    """The type the extension names, where it is or specialises the content verdict (extensions .txt, .html,
    .csv and .json occur)."""
    ext = f"regexp_extract({path}, '[.]([a-z]+)$', 1)"
    return f"""CASE WHEN {content_type} IS NULL THEN NULL
      WHEN {ext} = 'txt' AND {content_type} IN ('text/plain', 'application/octet-stream') THEN 'text/plain'
      WHEN {ext} = 'html' AND {content_type} IN ('text/html', 'text/plain', 'application/octet-stream') THEN 'text/html'
      WHEN {ext} = 'csv' AND {content_type} IN ('text/csv', 'text/plain', 'application/octet-stream') THEN 'text/csv'
      WHEN {ext} = 'json' AND {content_type} IN
        ('application/json', 'application/javascript', 'text/plain', 'application/octet-stream') THEN 'application/json'
      ELSE {content_type} END"""


# --- per-query oracle SQL ------------------------------------------------------

def _nonempty(col: str) -> str:
    return f"({col} IS NOT NULL AND octet_length({col}) > 0)"


def _nonempty_text(col: str) -> str:
    return f"({col} IS NOT NULL AND strlen({col}) > 0)"


_FILE_SIZE = ("CASE WHEN file_size IS NOT NULL AND strlen(file_size) > 0 "
              "THEN CAST(file_size AS BIGINT) ELSE 0 END")

_DUP_CTES = """
, g AS (SELECT t, count(*) AS n, min(label) AS first_file FROM files GROUP BY t HAVING count(*) > 1),
m AS (SELECT files.t, g.n, g.first_file, files.id, files.file_path, files.label FROM files JOIN g ON files.t = g.t),
lines AS (SELECT t, first_file, 0 AS line, '' AS label FROM g
          UNION ALL SELECT t, first_file, 1, label FROM m
          UNION ALL SELECT t, first_file, 2, '' FROM g)
"""


def _inline_type() -> str:
    return content_type_sql("inline_text")


_TYPE_CTES = f"""
, it AS (SELECT id, file_path, {_inline_type()} AS content_type FROM ev WHERE {_nonempty('file_content')}),
xt AS (SELECT e.id, e.file_path, {content_type_sql('x.t')} AS content_type
       FROM ext x JOIN ev e ON e.id = x.id),
types AS (SELECT id, {refine_sql('content_type', 'file_path')} AS media_type FROM it
          UNION ALL
          SELECT id, {refine_sql('content_type', 'file_path')} AS media_type FROM xt)
"""

_RAW_CTE = """
, raw AS (SELECT '/raw/' || grp || '/' || id AS path, n_bytes AS length, t FROM f2 WHERE t IS NOT NULL)
"""

_HASH_CTES = """
, hashes AS (SELECT id, sha256(inline_text) AS file_hash FROM ev WHERE file_content IS NOT NULL
                 AND octet_length(file_content) > 0
             UNION ALL SELECT id, sha256(t) AS file_hash FROM ext)
"""


def _runs_sql(name: str, pattern: str) -> str:
    """CTE of the runs of ``pattern`` in every file's text, with byte offsets from the pieces between them."""
    return f"""
, {name}_cut AS (SELECT id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps
                 FROM files),
{name}_each AS (SELECT id, unnest(range(len(found))) AS k, unnest(found) AS run, unnest(gaps[1:len(found)]) AS gap
                FROM {name}_cut),
{name} AS (SELECT id, k, run, CAST(sum(octet_length(encode(gap)) + strlen(run)) OVER (PARTITION BY id ORDER BY k)
                                   - strlen(run) AS BIGINT) AS "offset" FROM {name}_each)"""


_STRING_CTES = _runs_sql("plain", "[\\x20-\\x7E\\t]{4,}") + _runs_sql("wide", "([\\x20-\\x7E\\t]\\x00){4,}") + """,
strings AS (SELECT id, "offset", 'ascii' AS encoding, run AS text FROM plain
            UNION ALL SELECT id, "offset", 'utf-16le', replace(run, chr(0), '') FROM wide)
"""

_WORD_CTES = _STRING_CTES + """,
numbered AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY encoding, "offset") - 1 AS s FROM strings),
split AS (SELECT id, s, regexp_extract_all(lower(text), '[0-9a-z]+') AS ws FROM numbered),
each_word AS (SELECT id, s, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM split),
words AS (SELECT id, w, s + row_number() OVER (PARTITION BY id ORDER BY s, i) - 1 AS p FROM each_word)
"""

# What the search queries ask for, as in the queries.
_SEARCHES = ["the of and", "en on", "from was by", "der und", "les de la", "secret wide text", "the nosuchword"]
_PHRASES = ["of the", "the of", "in the on", "de la", "a secret", "secret wide text", "the the", "nosuchword the"]
_RANKED = ["the", "of and", "en in on", "der die und", "les de la", "secret wide text", "tion from", "is are be was",
           "nosuchword", "the nosuchword k"]


def _asked(texts: list[str]) -> str:
    rows = [f"({n}, {i}, '{w}')" for n, text in enumerate(texts) for i, w in enumerate(text.split())]
    return f", asked(query, i, w) AS (VALUES {', '.join(rows)})"


# What each media-type search means, of the types that the tables' content can have.
_TYPE_SEARCHES = {
    "text/*": "starts_with(media_type, 'text/') OR media_type IN ('application/json', 'application/javascript', "
              "'application/xml', 'image/svg+xml', 'application/xhtml+xml', 'application/rss+xml', "
              "'application/atom+xml', 'application/postscript', 'application/x-sh')",
    "application/xml": "media_type IN ('application/xml', 'image/svg+xml', 'application/xhtml+xml', 'application/rss+xml', "
                       "'application/atom+xml')",
    "archive": "media_type IN ('application/zip', 'application/x-bzip2', 'application/x-rar-compressed', "
               "'application/x-tar')",
    "image/*": "starts_with(media_type, 'image/')",
    "application/ogg": "media_type = 'application/ogg'",
    "program": "media_type IN ('application/x-executable', 'application/x-msdownload')",
    "text/html": "media_type = 'text/html'",
}

_PAGES = _DUP_CTES + """, placed AS (SELECT t, n, first_file, sha256(t) AS file_hash,
  row_number() OVER (ORDER BY n DESC, sha256(t)) - 1 AS place FROM g),
paged AS (SELECT *, place // 20 AS page FROM placed)
"""

_REPORT_LINES = ["'File Path =' || coalesce(file_path, 'null')", "'Owner =' || coalesce(owner, 'null')",
                 "'Group =' || coalesce(\"group\", 'null')", "'Permissions =' || coalesce(permissions, 'null')",
                 f"'File Length =' || CAST({_FILE_SIZE} AS VARCHAR)",
                 "'Access Time =' || coalesce(last_accessed, 'null')",
                 "'Modification Time =' || coalesce(last_modified, 'null')",
                 "'Change Time =' || coalesce(last_changed, 'null')", "'Creation Time =' || coalesce(created, 'null')", "''"]

ORACLE_SQL: dict[str, str] = {
    "media_type_search": with_evidence(_TYPE_CTES + " UNION ALL ".join(
        f"SELECT '{name}' AS query, id, media_type FROM types WHERE {condition}"
        for name, condition in _TYPE_SEARCHES.items())),
    "duplicate_pages": with_evidence(_PAGES + "SELECT page, place, n, file_hash, first_file FROM paged"),
    "duplicate_page": with_evidence(
        _PAGES + "SELECT page, place, paged.n, file_hash, paged.first_file, label FROM paged JOIN m ON m.t = paged.t "
        "WHERE page = 3"),
    "upserted_media_types": with_evidence(_TYPE_CTES + "SELECT id, media_type FROM types"),
    "attribute_report": with_evidence(" UNION ALL ".join(
        f"SELECT id, {n} AS line, {value} AS value FROM ev" for n, value in enumerate(_REPORT_LINES))),
    "content_strings": with_evidence(_STRING_CTES + 'SELECT id, "offset", encoding, text FROM strings'),
    "keyword_index": with_evidence(
        _WORD_CTES + "SELECT w AS term, id, count(*) AS n, min(p) AS first_position, max(p) AS last_position, "
        "CAST(sum(p) AS BIGINT) AS sum_positions FROM words GROUP BY w, id"),
    "keyword_search": with_evidence(
        _WORD_CTES + _asked(_SEARCHES) + ", need AS (SELECT query, count(DISTINCT w) AS n FROM asked GROUP BY query) "
        "SELECT query, id FROM asked JOIN (SELECT DISTINCT id, w FROM words) USING (w) JOIN need USING (query) "
        "GROUP BY query, id, need.n HAVING count(DISTINCT w) = need.n"),
    "phrase_search": with_evidence(
        _WORD_CTES + _asked(_PHRASES) + ", need AS (SELECT query, count(*) AS n FROM asked GROUP BY query), "
        "hits AS (SELECT query, id, p - i AS start FROM asked JOIN words USING (w) JOIN need USING (query) "
        "GROUP BY query, id, p - i, need.n HAVING count(DISTINCT i) = need.n) "
        "SELECT query, id, count(*) AS n_hits FROM hits GROUP BY query, id"),
    "ranked_search": with_evidence(
        _WORD_CTES + _asked(_RANKED) + ", lens AS (SELECT files.id, count(w) AS len FROM files LEFT JOIN words USING (id) "
        "GROUP BY files.id), total AS (SELECT count(*) AS n, avg(len) AS length FROM lens), "
        "tf AS (SELECT id, w, count(*) AS tf FROM words GROUP BY id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), "
        "s AS (SELECT query, id, round(sum(ln(1 + (total.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE "
        "/ (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / total.length))), 6) AS score "
        "FROM (SELECT DISTINCT query, w FROM asked) JOIN tf USING (w) JOIN df USING (w) JOIN lens USING (id), total "
        "GROUP BY query, id), "
        "ranked AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, id, score FROM s) "
        "SELECT query, CAST(rank AS INTEGER) AS rank, id, score FROM ranked WHERE rank <= 10"),
    "file_metadata": with_evidence(
        f"SELECT id, file_path, file_type, {_FILE_SIZE} AS file_size, owner, \"group\", permissions, "
        "last_modified, last_changed, last_accessed, created FROM ev"),
    "data_file_content": with_evidence(
        "SELECT id, file_path, external_path, "
        "coalesce(CAST(octet_length(file_content) AS BIGINT), -1) AS content_size, sha256(inline_text) AS content_sha256 "
        "FROM ev WHERE file_type = 'DATA_FILE'"),
    "inline_content": with_evidence(
        "SELECT id, CAST(octet_length(file_content) AS BIGINT) AS content_size, "
        f"sha256(inline_text) AS content_sha256 FROM ev WHERE {_nonempty('file_content')}"),
    "inline_content_with_path": with_evidence(
        "SELECT id, file_path, CAST(octet_length(file_content) AS BIGINT) AS content_size, "
        f"sha256(inline_text) AS content_sha256 FROM ev WHERE {_nonempty('file_content')}"),
    "external_paths": with_evidence(
        f"SELECT id, external_path FROM ev WHERE {_nonempty_text('external_path')}"),
    "external_original_paths": with_evidence(
        f"SELECT id, file_path FROM ev WHERE {_nonempty_text('external_path')}"),
    "external_data_files": with_evidence(
        "SELECT id, file_path, external_path FROM ev "
        f"WHERE file_type = 'DATA_FILE' AND {_nonempty_text('external_path')}"),
    "content_sizes": with_evidence(
        "SELECT id, CAST(octet_length(file_content) AS BIGINT) AS content_size "
        f"FROM ev WHERE {_nonempty('file_content')}"),
    "metadata_preview": with_evidence(
        f"SELECT id, file_path, {_FILE_SIZE} AS file_size FROM ev ORDER BY id LIMIT 10"),
    "content_messages": with_evidence(
        "SELECT id, printf('Entry = %s with relativePath = %s and hdfsPath = %s "
        "and hbase content size =%d.', id, coalesce(file_path, 'null'), coalesce(external_path, 'null'), "
        "coalesce(CAST(octet_length(file_content) AS BIGINT), -1)) AS message "
        f"FROM ev WHERE file_type = 'DATA_FILE' AND {_nonempty_text('external_path')}"),
    "evidence_counts": with_evidence(
        "SELECT count(*) AS n_files, "
        f"count(CASE WHEN {_nonempty('file_content')} THEN 1 END) AS n_inline FROM ev"),
    "file_hashes": with_evidence(
        "SELECT id, min(id) OVER (PARTITION BY t) AS first_id, count(*) OVER (PARTITION BY t) AS n FROM files"),
    "file_hashes_sha256": with_evidence(_HASH_CTES + "SELECT id, file_hash FROM hashes"),
    "hash_and_path": with_evidence(
        _HASH_CTES + "SELECT e.id, e.file_path, h.file_hash FROM ev e JOIN hashes h ON e.id = h.id"),
    "merged_hashes": with_evidence(
        _HASH_CTES + "SELECT coalesce(e.id, h.id) AS id, e.file_path, e.file_type, "
        "coalesce(h.file_hash, CAST(NULL AS VARCHAR)) AS file_hash "
        "FROM ev e FULL OUTER JOIN hashes h ON e.id = h.id"),
    "external_id_collisions": with_evidence(
        ", named AS (SELECT regexp_extract(path, '[^/]*$', 0) AS id, path FROM stored), "
        "c AS (SELECT id, count(*) AS n FROM named GROUP BY id HAVING count(*) > 1) "
        "SELECT named.id, named.path, c.n FROM named JOIN c ON named.id = c.id"),
    "hash_counts": with_evidence(
        "SELECT min(label) AS first_file, count(*) AS n FROM files GROUP BY t"),
    "duplicate_files": with_evidence(_DUP_CTES + "SELECT n, first_file, label FROM m"),
    "duplicate_members": with_evidence(_DUP_CTES + "SELECT n, id, file_path, label FROM m"),
    "duplicate_preview": with_evidence(
        _DUP_CTES + "SELECT m.n, m.first_file, label FROM m JOIN "
        "(SELECT t FROM g ORDER BY n DESC, first_file ASC LIMIT 20) k ON m.t = k.t"),
    "duplicate_report": with_evidence(
        _DUP_CTES + "SELECT first_file, line, CASE WHEN line = 0 THEN 'SHA512-Hash:  ' ELSE label END AS value "
        "FROM lines"),
    "duplicate_report_sha256": with_evidence(
        _DUP_CTES + "SELECT sha256(t) AS file_hash, line, "
        "CASE WHEN line = 0 THEN 'SHA256-Hash: ' || sha256(t) || ' ' ELSE label END AS value FROM lines"),
    "file_media_types": with_evidence(_TYPE_CTES + "SELECT id, media_type FROM types"),
    "media_types": with_evidence(
        _TYPE_CTES + "SELECT id, media_type FROM types WHERE media_type IS NOT NULL AND strlen(media_type) > 0"),
    "media_type_counts": with_evidence(
        _TYPE_CTES + "SELECT media_type, count(*) AS n FROM types WHERE media_type IS NOT NULL "
        "GROUP BY media_type"),
    "inline_media_type_mismatch": with_evidence(
        _TYPE_CTES + ", r AS (SELECT id, file_path, content_type AS type_by_content, "
        f"{refine_sql('content_type', 'file_path')} AS type_with_name FROM it) "
        "SELECT * FROM r WHERE type_by_content IS DISTINCT FROM type_with_name"),
    "external_summaries_sha256": with_evidence(
        f"SELECT path, length, sha256(t) AS file_hash, {content_type_sql('t')} AS content_type FROM stored"),
    "external_content": with_evidence("SELECT id, path, length FROM stored"),
    "directory_files": with_evidence(_RAW_CTE + "SELECT path, length FROM raw"),
    "directory_hashes_sha256": with_evidence(
        _RAW_CTE + f"SELECT path, length, sha256(t) AS file_hash, {content_type_sql('t')} AS content_type FROM raw"),
    "directory_duplicates_sha256": with_evidence(
        _RAW_CTE + ", g AS (SELECT t FROM raw GROUP BY t HAVING count(*) > 1) "
        "SELECT sha256(t) AS file_hash, 0 AS line, 'SHA256-Hash: ' || sha256(t) || ' ' AS value FROM g "
        "UNION ALL SELECT sha256(raw.t), 1, path FROM raw JOIN g ON raw.t = g.t "
        "UNION ALL SELECT sha256(t), 2, '' FROM g"),
    "whole_directory_files": with_evidence(_RAW_CTE + "SELECT path, length FROM raw"),
    "whole_directory_hashes_sha256": with_evidence(
        _RAW_CTE + f"SELECT path, length, sha256(t) AS file_hash, {content_type_sql('t')} AS content_type FROM raw"),
    "whole_directory_duplicates_sha256": with_evidence(
        _RAW_CTE + ", g AS (SELECT t FROM raw GROUP BY t HAVING count(*) > 1) "
        "SELECT sha256(t) AS file_hash, 0 AS line, 'SHA256-Hash: ' || sha256(t) || ' ' AS value FROM g "
        "UNION ALL SELECT sha256(raw.t), 1, path FROM raw JOIN g ON raw.t = g.t "
        "UNION ALL SELECT sha256(t), 2, '' FROM g"),
    "inline_content_types": with_evidence(_TYPE_CTES + "SELECT id, content_type FROM it"),
    "external_media_types": with_evidence(
        _TYPE_CTES + f"SELECT id, {refine_sql('content_type', 'file_path')} AS media_type FROM xt"),
    "external_media_type_mismatch": with_evidence(
        _TYPE_CTES + ", r AS (SELECT id, file_path, content_type AS type_by_content, "
        f"{refine_sql('content_type', 'file_path')} AS type_with_name FROM xt) "
        "SELECT * FROM r WHERE type_by_content IS DISTINCT FROM type_with_name"),
    "merged_media_types": with_evidence(
        _TYPE_CTES + "SELECT coalesce(e.id, t.id) AS id, e.file_path, t.media_type "
        "FROM ev e FULL OUTER JOIN types t ON e.id = t.id"),
}
