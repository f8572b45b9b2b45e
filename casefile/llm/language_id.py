"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords, the windows of two to four
characters inside a word (its borders included), hashed to ``BUCKETS``.  Embeddings and
softmax are trained by stochastic gradient descent in numpy.  A prediction's score is
its probability times the share of the text's subwords that training has seen, so text
of an unknown language scores low however sure the softmax is.  The temperature and
the score below which a prediction is rejected are set on rows kept back from training.

The model is fitted on a bounded sample: at most ``max_rows`` labelled rows, drawn by
a hash of the id in equal shares for each label.  Only their bucket counts reach the
driver.  Prediction reads every text whole and needs no shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected; without labelled rows every text is ``und``.  Equal texts get equal
predictions; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from casefile.llm.common import BATCH_BYTES, batches_by_bytes

BUCKETS = 1 << 16
WINDOWS = (2, 3, 4)
DIMENSIONS = 16
UNKNOWN = "und"
#: Rows of a label that may be drawn beyond its share (the number drawn varies).
SPARE_ROWS = 200
_SPREAD = np.uint32(2654435761)


class _Letters:
    """Which code points are letters, filled in as they are met."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        kind = self.known[codes]
        for c in np.unique(codes[kind == 0]).tolist():
            self.known[c] = 1 if chr(c).isalpha() else -1
        return self.known[codes] > 0


_LETTERS = _Letters()


def subwords(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, text of each, whether a text has a letter): all subwords of all texts, in order of window size."""
    low = [f" {(t or '').lower()} " for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    letter = _LETTERS.of(codes)
    codes = np.where(letter, codes, np.uint32(32))
    owner = np.repeat(np.arange(len(low)), sizes)
    has = np.zeros(len(low), bool)
    has[owner[letter]] = True
    buckets, owners = [], []
    for width in WINDOWS:
        count = len(codes) - width + 1
        if count <= 0:
            continue
        code = np.full(count, width, np.uint32)
        inner = np.ones(count, bool)
        some = np.zeros(count, bool)
        for k in range(width):
            code = (code ^ codes[k:k + count]) * _SPREAD
            code ^= code >> np.uint32(15)
            some |= letter[k:k + count]
            if 0 < k < width - 1:
                inner &= letter[k:k + count]
        # two blanks part neighbouring texts, so no window with letters at both ends spans them
        inner &= some & (owner[:count] == owner[width - 1:])
        buckets.append((code[inner] % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(owner[:count][inner])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x langs: embeddings times softmax weights
    bias: np.ndarray
    seen: np.ndarray  # BUCKETS: met in training
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its score, whether a text has a letter)."""
        buckets, owners, has = subwords(texts)
        n = len(texts)
        count = np.maximum(np.bincount(owners, minlength=n), 1)
        sums = np.stack([np.bincount(owners, self.logits[buckets, k], n) for k in range(len(self.langs))], 1)
        known = np.bincount(owners, self.seen[buckets], n) / count
        p = _softmax((sums / count[:, None] + self.bias) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1) * known, has


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[str], epochs: int = 8, rate: float = 8.0,
          seed: int = 1, keep_correct: float = 0.999, max_threshold: float = 0.3) -> Model:
    """Fit on rows of (buckets, counts).  Every fifth row is kept back to set temperature and rejection.

    ``keep_correct``: the share of correctly predicted kept-back rows that must not be rejected;
    ``max_threshold``: a score from which nothing is rejected.
    """
    langs = sorted(set(labels))
    random = np.random.default_rng(seed)
    target = np.array([langs.index(y) for y in labels])
    order = random.permutation(len(rows))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    if len(rows) < 5 * len(langs):
        used = order
    embed = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = random.normal(0, 0.1, (DIMENSIONS, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    seen = np.zeros(BUCKETS, bool)

    def gathered(picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, their shares, and where each row begins."""
        sizes = np.array([len(rows[k][0]) for k in picked])
        shares = np.concatenate([rows[k][1] / rows[k][1].sum() for k in picked])
        return np.concatenate([rows[k][0] for k in picked]), shares.astype(np.float32), np.cumsum(sizes) - sizes

    steps, step = epochs * -(-len(used) // 32), 0
    for _ in range(epochs):
        mixed = random.permutation(used)
        for at in range(0, len(mixed), 32):
            picked = mixed[at:at + 32]
            buckets, shares, begins = gathered(picked)
            seen[buckets] = True
            hidden = np.add.reduceat(embed[buckets] * shares[:, None], begins)
            error = _softmax(hidden @ weight + bias)
            error[np.arange(len(picked)), target[picked]] -= 1
            error *= rate * (1 - step / steps) / len(picked)
            back = np.repeat(error @ weight.T, np.diff(begins, append=len(buckets)), axis=0)
            weight -= hidden.T @ error
            bias -= 0.1 * error.sum(axis=0)
            np.subtract.at(embed, buckets, back * shares[:, None])
            step += 1
    model = Model(langs, embed @ weight, bias, seen)
    if len(held):
        buckets, shares, begins = gathered(held)
        z = np.add.reduceat(model.logits[buckets] * shares[:, None], begins).astype(float) + model.bias
        known = np.add.reduceat(seen[buckets] * shares, begins)
        mine = np.arange(len(held)), target[held]
        # on rows that can be told apart without error the best temperature is 0: it is never below 1
        losses = {t: -np.log(_softmax(z / t)[mine] + 1e-12).mean() for t in np.geomspace(1, 20, 41)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        correct = p.argmax(axis=1) == target[held]
        if correct.any():
            lowest = float(np.quantile((p.max(axis=1) * known)[correct], 1 - keep_correct))
            model.reject_below = min(0.9 * lowest, max_threshold)
    return model


def fit(docs: DataFrame, max_rows: int = 2400, label_col: str = "lang", id_col: str = "doc_id",
        text_col: str = "text", may_train: Column | None = None) -> Model | None:
    """Fit on about ``max_rows`` labelled rows (those with ``may_train``), in equal shares for each label.

    Rows are drawn by a hash of id and text, so rows that share an id, or have none, are drawn one by one; each
    label gives at least its first row by that hash.  Of equal rows, drawn together, a label gives no more than
    its share and ``SPARE_ROWS``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(label_col).cast("string").alias("label"),
                       (F.lit(True) if may_train is None else may_train).alias("may")) \
        .where("may and label is not null and text is not null")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col("id").cast("string"), F.col("text")), F.lit(1 << 30))
    drawn = rows.withColumn("draw", draw)
    counts = {r["label"]: r for r in drawn.groupBy("label").agg(  # one row per language
        F.count("*").alias("n"), F.min("draw").alias("first")).collect()}
    if not counts:
        return None
    share = -(-max_rows // len(counts))
    bounds = F.create_map(*[F.lit(v) for y, r in counts.items()
                            for v in (y, max(r.first + 1, min(1 << 30, (share << 30) // r.n)))])
    picked = drawn.where(F.col("draw") < bounds[F.col("label")]).select("text", "label", "draw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", BATCH_BYTES):
            buckets, owners, _ = subwords(batch.column("text").to_pylist())
            keys, times = np.unique(owners * BUCKETS + buckets, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(batch.num_rows + 1) * BUCKETS).tolist()
            # buckets ascend: their gaps and the counts are small numbers, which compress well
            packed = [zlib.compress(np.stack([np.diff(keys[b:e] % BUCKETS, prepend=0), times[b:e]])
                                    .astype("<i4").tobytes(), 1) for b, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("draw"), pa.array(packed, pa.binary())],
                                             names=["label", "draw", "packed"])

    order = Window.partitionBy("label").orderBy("draw", "packed")
    found = (picked.mapInArrow(count, "label string, draw long, packed binary")
             .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= share + SPARE_ROWS)
             .select("label", "packed").toArrow())
    labels, features = found["label"].to_pylist(), []
    for packed in found["packed"]:
        gaps, times = np.frombuffer(zlib.decompress(packed.as_buffer()), "<i4").reshape(2, -1)
        features.append((np.cumsum(gaps, dtype=np.int32), times.astype(np.float32)))
    # rows come in any order: a fixed one makes the fit the same each time
    order = sorted(range(len(labels)), key=lambda k: (labels[k], len(features[k][0]), features[k][0].tobytes(),
                                                      features[k][1].tobytes()))
    order = [k for k in order if len(features[k][0])]
    return train([features[k] for k in order], [labels[k] for k in order]) if order else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, lang_pred, score, rejected) for every document."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", BATCH_BYTES):
            langs, score, rejected = judge(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score),
                                              pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return given.mapInArrow(run, StructType([given.schema["id"], StructField("lang_pred", StringType()),
                                             StructField("score", DoubleType()),
                                             StructField("rejected", BooleanType())]))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected; needs no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, text_col, BATCH_BYTES):
            yield batch.filter(pa.array(~judge(batch.column(text_col).to_pylist(), model)[2]))

    return docs.mapInArrow(run, docs.schema)


def judge(texts: Sequence[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    best, score, has = model.scores(texts)
    score = np.where(has, score, 0.0)
    return ([model.langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], score,
            ~has | (score < model.reject_below))
