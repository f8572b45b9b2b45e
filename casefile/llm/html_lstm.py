"""HTML extraction: a recurrent block labeller.

A page is the sequence of its leaf blocks (``html_blocks``).  A block's vector joins
the summed embeddings of the names on its tag path, the mean embedding of its hashed
words and some shape measures.  A bidirectional LSTM in numpy reads the whole sequence,
so each block is judged main text or not in the context of the entire page.

The model is trained here, on the driver, on ``TRAINING_PAGES`` pages from a generator
of page layouts (``html_layouts``) whose blocks are labelled by construction; random
seeds are fixed.  It has a constant size (about 0.2 MB) and travels with the tasks.

Defined results: a null or empty page, or one without main text, has the empty text;
every page is judged by itself, so repeated rows get equal results; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from casefile.llm import html_layouts
from casefile.llm.anchors import Sums
from casefile.llm.common import BATCH_BYTES, batches_by_bytes
from casefile.llm.html_blocks import blocks

PATH_BUCKETS, PATH_SIZE = 2048, 16
WORD_BUCKETS, WORD_SIZE = 1024, 6
SHAPES = 9
HIDDEN = 20
TRAINING_PAGES = 1500
#: Blocks of pages that go through the network together.
STEP_BLOCKS = 1 << 14

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True


@functools.lru_cache(maxsize=200_000)
def _path_codes(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Buckets of the names on a path; those of the leaf count again as the leaf's."""
    names = {n for names in path for n in names}
    if path:
        names |= {"leaf " + n for n in path[-1]}
        names |= {"above " + n for n in path[-2]} if len(path) > 1 else {"above nothing"}
    return np.array(sorted(zlib.crc32(n.encode()) % PATH_BUCKETS for n in names), np.int64)


class Pages:
    """The vectors' raw material for a batch of pages, all blocks in one row of arrays."""

    def __init__(self, parsed: Sequence[list]):
        every = [b for page in parsed for b in page]
        self.sizes = np.array([len(p) for p in parsed], np.int64)
        paths = [_path_codes(b[0]) for b in every]
        self.path = np.concatenate([np.zeros(0, np.int64), *paths])
        self.path_of = np.repeat(np.arange(len(every)), [len(p) for p in paths])
        texts = [b[1].encode() for b in every]
        lengths = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        raw = _LOW[raw]
        starts = np.cumsum(lengths + 1) - lengths - 1
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = ~_SPACE[raw]
        turns = np.diff(solid)
        begins, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        self.word = (Sums(raw, 0).hashes(begins, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.word_of = np.searchsorted(starts, begins, side="right") - 1
        words = np.bincount(self.word_of, minlength=len(every))
        self.share = 1 / np.maximum(words, 1)

        def per_block(which):
            sums = np.concatenate([[0], np.cumsum(which[raw], dtype=np.int64)])
            return sums[starts + lengths] - sums[starts]

        number = np.arange(len(every)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        total = np.repeat(self.sizes, self.sizes)
        linked = np.array([b[2] for b in every], float)
        long = np.maximum(lengths, 1)
        last = raw[starts + lengths - 1] if len(every) else np.zeros(0, np.uint8)
        self.shape = np.stack([
            np.log1p(words) / 3, np.log1p(lengths) / 5, np.minimum(1, linked / long), per_block(_STOPS) / long * 10,
            per_block(_DIGITS) / long * 5, _STOPS[last], number / np.maximum(total, 1), words < 5, words > 20],
            1).astype(np.float32)


class Network:
    def __init__(self, random: np.random.Generator):
        size = PATH_SIZE + WORD_SIZE + SHAPES
        self.p = {"path": random.normal(0, 0.1, (PATH_BUCKETS, PATH_SIZE)),
                  "word": random.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)),
                  "out": random.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for way in "fb":
            self.p[f"x{way}"] = random.normal(0, size ** -0.5, (size, 4 * HIDDEN))
            self.p[f"h{way}"] = random.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def vectors(self, pages: Pages) -> np.ndarray:
        n = len(pages.shape)
        path, word = np.zeros((n, PATH_SIZE), np.float32), np.zeros((n, WORD_SIZE), np.float32)
        for k in range(PATH_SIZE):
            path[:, k] = np.bincount(pages.path_of, self.p["path"][pages.path, k], n)
        for k in range(WORD_SIZE):
            word[:, k] = np.bincount(pages.word_of, self.p["word"][pages.word, k], n) * pages.share
        return np.concatenate([path, word, pages.shape], axis=1)

    def _run(self, x: np.ndarray, live: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """One direction over ``steps x pages x size``; pages that have ended keep their state."""
        weight, memory = self.p[f"h{way}"], []
        ahead = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = ahead[t] + h @ weight
            gate = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            bent = np.tanh(new)
            on = live[t][:, None]
            memory.append((t, h, c, i, f, o, g, bent))
            c = np.where(on, new, c)
            h = np.where(on, o * bent, h)
            out[t] = h * on
        return out, memory

    def forward(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
        ahead, kept_f = self._run(x, live, "f")
        back, kept_b = self._run(x, live, "b")
        both = np.concatenate([ahead, back], axis=2)
        z = (both @ self.p["out"])[:, :, 0] + self.p["bias"]
        return 1 / (1 + np.exp(-z)), (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, live: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        p, (both, *kept) = self.forward(x, live)
        error = ((p - target) * live / max(1, live.sum())).astype(np.float32)
        grads = {"out": np.einsum("tbh,tb->h", both, error)[:, None], "bias": error.sum(keepdims=True)[0]}
        spread = error[:, :, None] * self.p["out"][:, 0]
        dx = np.zeros_like(x)
        for way, memory, part in (("f", kept[0], spread[:, :, :HIDDEN]), ("b", kept[1], spread[:, :, HIDDEN:])):
            weight, wide = self.p[f"h{way}"], self.p[f"x{way}"]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dw = {k: np.zeros_like(self.p[k + way]) for k in "xhc"}
            for t, h, c, i, f, o, g, bent in reversed(memory):
                on = live[t][:, None]
                whole = dh + part[t]
                into = whole * on
                d_new = dc * on + into * o * (1 - bent * bent)
                dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), into * bent * o * (1 - o),
                                     d_new * i * (1 - g * g)], axis=1)
                dw["x"] += x[t].T @ dz
                dw["h"] += h.T @ dz
                dw["c"] += dz.sum(axis=0)
                dx[t] += dz @ wide.T
                dh = np.where(on, dz @ weight.T, dh)
                dc = np.where(on, d_new * f, dc)
            grads |= {k + way: v for k, v in dw.items()}
        return grads, dx


def _laid_out(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of pages one after the other -> steps x pages, with a mask and the places of the rows."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes), *values.shape[1:]), np.float32)
    out[step, page] = values
    live = np.zeros(out.shape[:2], bool)
    live[step, page] = True
    return out, live, step, page


def train(pages: int = TRAINING_PAGES, epochs: int = 5, seed: int = 5, rate: float = 0.01) -> Network:
    """Fit to generated layouts by Adam on the cross entropy of all blocks."""
    random = np.random.default_rng(seed)
    made = [html_layouts.page(random) for _ in range(pages)]
    parsed, labels = [], []
    for source, main in made:
        found = blocks(source)
        parsed.append(found)
        labels.append(np.array([b[1] in main for b in found], np.float32))
    net = Network(random)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps, at = epochs * -(-pages // 32), 0
    for _ in range(epochs):
        order = random.permutation(pages)
        order = order[np.argsort([len(parsed[k]) // 12 for k in order], kind="stable")]
        groups = [order[k:k + 32] for k in range(0, pages, 32)]
        for g in random.permutation(len(groups)):
            picked = groups[g]
            batch = Pages([parsed[k] for k in picked])
            x, live, step, page = _laid_out(net.vectors(batch), batch.sizes)
            target = np.zeros(live.shape, np.float32)
            target[step, page] = np.concatenate([labels[k] for k in picked])
            grads, dx = net.gradients(x, live, target)
            rows = dx[step, page]
            grads["path"], grads["word"] = np.zeros_like(net.p["path"]), np.zeros_like(net.p["word"])
            np.add.at(grads["path"], batch.path, rows[batch.path_of, :PATH_SIZE])
            np.add.at(grads["word"], batch.word, (rows[:, PATH_SIZE:PATH_SIZE + WORD_SIZE]
                                                  * batch.share[:, None])[batch.word_of])
            at += 1
            for k, grad in grads.items():
                mean, square = moment[k]
                grad = grad + 1e-5 * net.p[k]
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                size = rate * min(1, 3 * (1 - at / (steps + 1)))
                net.p[k] -= size * (mean / (1 - 0.9 ** at)) / (np.sqrt(square / (1 - 0.99 ** at)) + 1e-8)
    return net


@functools.lru_cache(maxsize=1)
def trained() -> Network:
    """The labeller (trained once per driver process)."""
    return train()


def label(net: Network, parsed: Sequence[list]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(parsed)
    order = sorted((k for k in range(len(parsed)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(parsed[order[stop]]) <= STEP_BLOCKS:
            stop += 1
        picked = order[at:stop]
        batch = Pages([parsed[k] for k in picked])
        x, live, step, page = _laid_out(net.vectors(batch), batch.sizes)
        main = net.forward(x, live)[0][step, page] > 0.5
        for k, part in zip(picked, np.split(main, np.cumsum(batch.sizes)[:-1])):
            out[k] = part
        at = stop
    return out


def main_texts(net: Network, pages: Sequence[str | None]) -> list[str]:
    parsed = [blocks(p or "") for p in pages]
    return ["\n".join(b[1] for b, keep in zip(page, kept) if keep) for page, kept in zip(parsed, label(net, parsed))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            net: Network | None = None) -> DataFrame:
    """Return (id, url, text, n_chars) for every page."""
    net = net or trained()
    given = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "html", BATCH_BYTES):
            texts = main_texts(net, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    schema = StructType([given.schema[0], given.schema["url"], StructField("text", StringType()),
                         StructField("n_chars", LongType())])
    return given.mapInArrow(run, schema)
