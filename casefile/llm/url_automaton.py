"""URL filters: a bit-parallel wildcard automaton over all rules at once.

Every rule becomes two glob patterns over the canonical URL ``host + path``: one for
the host itself, one for its subdomains.  All patterns lie side by side in one
multiword Shift-And mask; one step per byte advances every pattern of every URL of a
batch.  ``*`` stands for any run without ``/``, ``**`` for any run; other bytes stand
for themselves.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule and gets the default verdict.  Repeated rows are judged alike, an empty table
gives an empty result, and columns beside the id and the URL are not read.  A URL of any length is judged whole;
one with a very long path costs little, as its state soon settles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from casefile.llm.common import BATCH_BYTES, batches_by_bytes

#: Bytes after which texts whose state can no longer change are put aside.
SETTLE = 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains where the path starts with ``path`` (both may hold wildcards)."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


@dataclass(frozen=True)
class Automaton:
    """Masks of ``words`` 64-bit words: per byte the steps and the loops, then start and accepting states."""

    step: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    accepting: list[tuple[int, int]]  # (word, bit) of each pattern's last state
    settled: np.ndarray  # the last states that loop on any byte: nothing changes them


def compile_globs(globs: Sequence[str]) -> Automaton:
    """State i of a pattern: its first i literal bytes are read.  Wildcards are loops on a state."""
    states = []  # per state: (literal byte that leads here or None, loop kind)
    accepting = []
    starts = []
    for glob in globs:
        starts.append(len(states))
        states.append([None, 0])
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i:i + 2] == b"**":
                states[-1][1] = 2
                i += 2
            elif raw[i:i + 1] == b"*":
                states[-1][1] = max(states[-1][1], 1)
                i += 1
            else:
                states.append([raw[i], 0])
                i += 1
        accepting.append(len(states) - 1)
    words = len(states) // 64 + 1
    step = np.zeros((256, words), np.uint64)
    loop = np.zeros((256, words), np.uint64)
    start = np.zeros(words, np.uint64)
    for n, (literal, kind) in enumerate(states):
        bit = np.uint64(1 << (n % 64))
        if literal is not None:
            step[literal, n // 64] |= bit
        if kind:
            loop[:, n // 64] |= bit
            if kind == 1:
                loop[ord("/"), n // 64] &= ~bit
    for n in starts:
        start[n // 64] |= np.uint64(1 << (n % 64))
    settled = np.zeros(words, np.uint64)
    for n in accepting:
        if states[n][1] == 2:
            settled[n // 64] |= np.uint64(1 << (n % 64))
    return Automaton(step, loop, start, [(n // 64, n % 64) for n in accepting], settled)


def run(automaton: Automaton, texts: Sequence[bytes]) -> np.ndarray:
    """For every text and pattern, whether the pattern fits the whole text (``len(texts) x patterns``).

    A text is read to its end, or until only states are live that no byte changes.
    """
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    begins = np.cumsum(sizes) - sizes
    state = np.repeat(automaton.start[None, :], n, axis=0)
    one, top = np.uint64(1), np.uint64(63)
    may_change = ~automaton.settled
    rows, now, at = np.arange(n), state, 0  # texts that are still read, longest first
    while True:
        live = int(np.searchsorted(-sizes[rows], -at, side="left"))
        reading = np.arange(len(rows)) < live
        if at % SETTLE == 0:
            reading &= (now & may_change).any(axis=1)
        if not reading.all():
            state[rows[~reading]] = now[~reading]
            rows, now = rows[reading], now[reading]
        if not len(rows):
            break
        byte = flat[begins[rows] + at]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        now = (moved & automaton.step[byte]) | (now & automaton.loop[byte])
        at += 1
    fits = np.zeros((n, len(automaton.accepting)), bool)
    for k, (word, bit) in enumerate(automaton.accepting):
        fits[order, k] = (state[:, word] >> np.uint64(bit)) & one != 0
    return fits


def canonical(url):
    """Column expressions (host, path): host after ``://`` with A-Z lower-cased; both empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw_host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return host, path


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return (id, host, path, rule, verdict).

    The rule with the longest text that fits wins; of equally long ones a block, then
    the first given.  Where none fits, ``rule`` is null and the verdict ``default``.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block"))
    automaton = compile_globs([g for r in ranked for g in r.globs()])
    texts, verdicts = [r.text for r in ranked], [r.verdict for r in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches_by_bytes(batches, "path", BATCH_BYTES), "host", BATCH_BYTES):
            urls = [(h + p).encode() for h, p in zip(batch.column("host").to_pylist(),
                                                     batch.column("path").to_pylist())]
            fits = run(automaton, urls).reshape(len(urls), len(texts), 2).any(axis=2)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if texts else np.full(len(urls), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("host"), batch.column("path"),
                 pa.array([texts[b] if b >= 0 else None for b in best], pa.string()),
                 pa.array([verdicts[b] if b >= 0 else default for b in best], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    host, path = canonical(F.col("__url"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url")).select(id_col, host.alias("host"),
                                                                            path.alias("path"))
    schema = StructType([rows.schema[id_col], StructField("host", StringType()), StructField("path", StringType()),
                         StructField("rule", StringType()), StructField("verdict", StringType())])
    return rows.mapInArrow(judge, schema)
