"""Periodic run detection: a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(least, 2q)`` that no neighbouring word extends.  Words are those between ASCII
white space.

Over a stretch of words, ``squares`` builds the suffix automaton.  Its suffix links form a
tree whose nodes are all substrings; a node's colour is the place where its substrings
ended last.  Nodes of one colour on the way to the root are one preferred path, kept in a
splay tree.  Each word, in order, accesses its prefix's node: the paths on the way to the
root are cut there and joined to one path of the new colour.  Each piece joined tells that
strings as long as its deepest node ended at ``previous`` before they end here; if the
distance is within that length, the two are adjacent and make a square.  Squares are
extended to runs.  An access costs O(log n) amortised, the number of pieces included.

Before that, stretches that cannot hold a run are set aside: in a run of at least
``least`` words, each word lies in a gram of ``least // 2`` words that occurs twice within
the run.  So only stretches covered by grams repeated in the same stretch are read word
by word; grams are found by hash, and equal hashes of different grams only add a stretch.

Documents are independent: nothing is shuffled, and a worker holds one batch of texts.

Defined results: a null text has no words; a text without a run keeps its words, joined by
one blank; rows with one id, also equal rows, are judged one by one; an empty table gives
an empty result; a text of any length is read whole (memory is in proportion to it);
extra columns are not read; ids of any type are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from casefile.llm.common import BATCH_BYTES, batches_by_bytes

#: Words of the shortest run.
LEAST = 12

Run = tuple[int, int, int]


def automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of ``words``: each state's longest length and suffix link, and the state of each prefix."""
    steps: list[dict[int, int]] = [{}]
    length, link, prefix = [0], [-1], []
    last = 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        steps.append({})
        state = last
        while state >= 0 and word not in steps[state]:
            steps[state][word] = new
            state = link[state]
        if state >= 0:
            target = steps[state][word]
            if length[target] > length[state] + 1:
                copy = len(length)
                length.append(length[state] + 1)
                link.append(link[target])
                steps.append(steps[target].copy())
                while state >= 0 and steps[state].get(word) == target:
                    steps[state][word] = copy
                    state = link[state]
                link[target] = copy
                target = copy
            link[new] = target
        last = new
        prefix.append(new)
    return length, link, prefix


class Paths:
    """Preferred paths of a rooted tree: splay trees over the nodes of one colour, deeper nodes to the right.

    Node 0 means none.  ``up`` of a splay tree's root is the node above its path's top; ``colour`` is
    valid at such roots.
    """

    def __init__(self, parents: Sequence[int]):
        self.up = list(parents)
        self.left = [0] * len(self.up)
        self.right = [0] * len(self.up)
        self.colour = [-1] * len(self.up)

    def _splay(self, node: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour

        def rotate(child: int, above: int) -> None:
            top = up[above]
            if left[above] == child:
                inner = left[above] = right[child]
                right[child] = above
            else:
                inner = right[above] = left[child]
                left[child] = above
            if inner:
                up[inner] = above
            if left[top] == above:
                left[top] = child
            elif right[top] == above:
                right[top] = child
            up[child], up[above] = top, child
            colour[child] = colour[above]  # right once the root has been passed

        while True:
            above = up[node]
            if not above or (left[above] != node and right[above] != node):
                return
            top = up[above]
            if top and (left[top] == above or right[top] == above):
                rotate(above if (left[above] == node) == (left[top] == above) else node,
                       top if (left[above] == node) == (left[top] == above) else above)
                above = up[node]
            rotate(node, above)

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the way from the root to ``node``; yields (deepest node, old colour) of the pieces joined."""
        up, right, colours = self.up, self.right, self.colour
        lower = 0
        while node:
            self._splay(node)
            old = colours[node]
            if old >= 0:
                yield node, old
            if right[node]:
                colours[right[node]] = old
            right[node] = lower
            lower = node
            node = up[node]
        colours[lower] = colour


def squares(words: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of squares in ``words``, by last word; at least each run's first square, and only
    primitive periods."""
    length, link, prefix = automaton(words)
    paths = Paths([0] + [n + 1 for n in link])
    for at, state in enumerate(prefix):
        for node, before in paths.access(state + 1, at):
            if at - before <= length[node - 1]:
                yield at, at - before


def runs_in(words: Sequence[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs in ``words``."""
    found, reach = [], {}
    for at, period in list(squares(words)):
        if at <= reach.get(period, -1):
            continue
        start, end = at - 2 * period + 1, at + 1
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        while end < len(words) and words[end] == words[end - period]:
            end += 1
        reach[period] = end - 1
        if end - start >= least:
            found.append((start, end - start, period))
    return found


def _cover(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches covered by ``width`` words from each of ``starts`` (ascending); touching ones are one."""
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + width


def stretches(words: np.ndarray, ends: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (begin, end) of ``words`` that may hold runs; texts end at ``ends``."""
    width = max(1, least // 2)
    if len(words) < least:
        return []
    factors = np.random.default_rng(11).integers(1, 1 << 62, width + 1, np.int64).astype(np.uint64) * 2 + 1
    grams = np.zeros(len(words) - width + 1, np.uint64)
    wide = words.astype(np.uint64)
    for k in range(width):
        part = wide[k:k + len(grams)] * factors[k]
        grams += (part ^ (part >> np.uint64(31))) * factors[(k + 1) % width]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = text[:len(grams)] == text[width - 1:]
    at = np.flatnonzero(inside)
    keys = grams[at] + text[at].astype(np.uint64) * factors[width]
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return []
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    chosen = twice[place] == keys
    at, keys = at[chosen], place[chosen]
    while len(at):
        begin, end = _cover(at, width)
        # a stretch may touch the next text's; grams of different texts never have equal keys
        of = np.searchsorted(begin, at, side="right") - 1
        _, back, count = np.unique(np.stack([of, keys], axis=1), axis=0, return_inverse=True, return_counts=True)
        stay = count[back.ravel()] > 1
        if stay.all():
            edges = np.concatenate([[0], ends])
            out = []
            for b, e in zip(begin.tolist(), end.tolist()):  # cut at the texts' borders
                first = int(np.searchsorted(edges, b, side="right"))
                last = int(np.searchsorted(edges, e, side="left"))
                marks = [b, *edges[first:last].tolist(), e]
                out += [(x, y) for x, y in zip(marks, marks[1:]) if y - x >= least]
            return out
        at, keys = at[stay], keys[stay]
    return []


def runs_of_texts(texts: Sequence[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each text (a list of words), by start and period."""
    known: dict[bytes, int] = {}
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    every = itertools.chain.from_iterable(texts)
    words = np.fromiter(map(known.setdefault, every, itertools.count()), np.int64, int(ends[-1]) if len(ends) else 0)
    out: list[list[Run]] = [[] for _ in texts]
    for begin, end in stretches(words, ends, least):
        of = int(np.searchsorted(ends, begin, side="right"))
        first = begin - (int(ends[of - 1]) if of else 0)
        out[of] += [(first + s, n, q) for s, n, q in runs_in(words[begin:end].tolist(), least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """The words joined by one blank, without those after the first period of any run."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s + q for s, _, q in runs], 1)
    np.add.at(change, [s + n for s, n, _ in runs], -1)
    return b" ".join(itertools.compress(words, np.cumsum(change)[:-1] == 0))


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_words, runs, collapsed): every text's runs, by start and period, and the text without repeats."""
    if least < 2:
        raise ValueError("a run has at least two words")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", BATCH_BYTES):
            texts = [t.split() if t else [] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = runs_of_texts(texts, least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], arrow_runs),
                 pa.array([collapse(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())],
                names=schema.names)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    arrow_runs = pa.list_(pa.struct([(n, pa.int64()) for n in run.names]))
    schema = StructType([StructField("id", given.schema["id"].dataType), StructField("n_words", LongType()),
                         StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    return given.mapInArrow(find, schema)
