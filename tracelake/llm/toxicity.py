"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. How many labelled texts of either class hold each hashed n-gram is counted over all training rows (whole
   texts). An n-gram's scale is the log ratio of its shares in the two classes. Some texts (the smoothing) are added to
   its counts, dealt to the classes by their sizes, so that an n-gram that was never seen has ratio 0.
2. A logistic regression is fitted on the scaled presence of all n-grams, on at most ``MAX_TRAINING`` rows, by
   tasks on the executors. Both classes weigh the same. Each row has length one, so that long texts don't outweigh others;
   the penalty settles n-grams that tell little.
3. Smoothing, penalty and threshold come from cross-validation: each fold is scored by a model, scales and weights, that hasn't
   seen it. The setting of least loss is taken, and the bias is moved to where most toxic texts less clean texts are
   rejected, with no more than ``FALSE_RATE`` of the clean ones.
4. Texts are scored with one broadcast table of 2 ** ``BITS`` weights. The driver holds counts and weights, never rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ngrams import present

ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows that the regression is fitted on, at most (half of them of each class, if there are).
MAX_TRAINING = 4_000
#: Smoothing and penalty, as tried.
SETTINGS = ((50.0, 0.1), (2.0, 0.1))
FALSE_RATE, FOLDS, STEPS = 0.0125, 3, 30
#: Rows of a class below which the threshold stays where the regression puts it.
FEW = 30


@dataclass
class Model:
    """``scales`` and ``weights`` (already scaled) of all buckets."""
    scales: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt((self.scales[found] ** 2).sum())
        return float(self.weights[found].sum() / max(length, 1e-6) + self.bias)

    def score(self, text: str | None) -> float:
        x = self.margin(present(text, ORDERS, BITS))
        return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


_COUNTS = [f"{name}{fold}" for fold in range(FOLDS) for name in ("clean", "toxic")]


def _count(rates: tuple[float, float]):
    """One pass over the training rows: how many texts of either label and each fold hold each n-gram, and
    the texts whose mark is below their label's rate."""
    names = ["feature", *_COUNTS, "text", "label", "mark"]
    kinds = [pa.int32(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.int32(), pa.int64()]
    none = len(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((none, 1 << BITS), np.int32)
        for batch in batches:
            taken = []
            for text, label, mark in zip(*(c.to_pylist() for c in batch.columns)):
                counts[2 * (mark % FOLDS) + label, present(text, ORDERS, BITS)] += 1
                if mark / 2 ** 63 < rates[label]:
                    taken.append((text or "", label, mark))
            cols = [[None] * len(taken)] * (none + 1) + ([list(c) for c in zip(*taken)] if taken else [[]] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), 1 << 16):
            part = used[at:at + (1 << 16)]
            cols = [part.astype(np.int32), *(c[part].astype(np.int64) for c in counts), *[[None] * len(part)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def log_count_ratio(clean: np.ndarray, toxic: np.ndarray, n0: float, n1: float, smoothing: float) -> np.ndarray:
    """Of the shares of the classes' texts that hold each n-gram."""
    return (np.log((toxic + smoothing * n1 / (n0 + n1)) / n1) - np.log((clean + smoothing * n0 / (n0 + n1)) / n0))


#: N-grams of the rows that are handled at once; what a row takes as bits.
_BLOCK, _ROW_BYTES = 1 << 20, (1 << BITS) // 8


def _bits(found: np.ndarray) -> bytes:
    row = np.zeros(1 << BITS, bool)
    row[found] = True
    return np.packbits(row).tobytes()


class _Rows:
    """The n-grams of each row, as bits where those are smaller: at most 2 ** ``BITS`` bits a row."""

    def __init__(self, packed: list[bytes], scales: np.ndarray):
        self.rows, self.sizes, self.scales = [], np.zeros(len(packed), np.int64), scales
        length = np.zeros(len(packed))
        for i, data in enumerate(packed):
            bits = np.frombuffer(zlib.decompress(data), np.uint8)
            found = np.flatnonzero(np.unpackbits(bits)).astype(np.int32)
            self.rows.append(found if found.nbytes <= _ROW_BYTES else bits)
            self.sizes[i], length[i] = len(found), (scales[found] ** 2).sum()
        self.length = np.maximum(np.sqrt(length), 1e-6)
        block = np.cumsum(self.sizes) // _BLOCK
        self.bounds = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for at, to in zip(self.bounds[:-1], self.bounds[1:]):
            yield slice(at, to), np.concatenate([r if r.dtype == np.int32 else np.flatnonzero(np.unpackbits(r))
                                                 for r in self.rows[at:to]])

    def times(self, w: np.ndarray) -> np.ndarray:
        out, scaled = np.zeros(len(self.rows)), w * self.scales
        for own, found in self._blocks():
            sizes = self.sizes[own]
            some = sizes > 0
            out[own][some] = np.add.reduceat(scaled[found], (np.cumsum(sizes) - sizes)[some]) if some.any() else 0
        return out / self.length

    def summed(self, by_row: np.ndarray) -> np.ndarray:
        out, by_row = np.zeros(1 << BITS), by_row / self.length
        for own, found in self._blocks():
            out += np.bincount(found, np.repeat(by_row[own], self.sizes[own]), 1 << BITS)
        return out * self.scales


def _fit(x: _Rows, y: np.ndarray, penalty: float, steps: int, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by L-BFGS, both classes of the same weight: the weights, and the bias last."""
    weight = np.where(y == 1, 0.5 * len(y) / max(y.sum(), 1), 0.5 * len(y) / max((1 - y).sum(), 1))
    sign = 2 * y - 1

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        w, margin = at[:-1], sign * (x.times(at[:-1]) + at[-1])
        gap = -sign * weight * np.exp(-np.logaddexp(0, margin))
        return (float((weight * np.logaddexp(0, -margin)).sum() + penalty / 2 * (w @ w)),
                np.r_[x.summed(gap) + penalty * w, gap.sum()])

    at, past = np.zeros((1 << BITS) + 1) if start is None else start, []
    value, slope = loss(at)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-9:
            break
        way, shares = slope.copy(), []
        for moved, bent, by in reversed(past):
            shares.append(by * (moved @ way))
            way -= shares[-1] * bent
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(slope)
        for (moved, bent, by), share in zip(past, reversed(shares)):
            way += (share - by * (bent @ way)) * moved
        size, falls = 1.0, float(way @ slope)
        while True:
            after, steep = loss(at - size * way)
            if after <= value - 1e-4 * size * falls or size < 1e-6:
                break
            size /= 2
        if after >= value:
            break
        moved, bent, gain = -size * way, steep - slope, value - after
        if moved @ bent > 1e-12:
            past = [*past[-7:], (moved, bent, 1 / (moved @ bent))]
        at, value, slope = at + moved, after, steep
        if gain < 1e-5 * value:
            break
    return at


def _sorted_group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Labels, folds and n-grams of a group's rows, in an order that doesn't depend on the shuffle."""
    found = sorted(zip(rows.column("label").to_pylist(), rows.column("fold").to_pylist(), rows.column("bits").to_pylist()))
    label, fold, bits = map(list, zip(*found)) if found else ([], [], [])
    return np.array(label, float), np.array(fold), bits


def threshold(y: np.ndarray, margin: np.ndarray, false_rate: float = FALSE_RATE) -> float:
    """The margin at which most of the toxic share less the clean share is rejected. Tried are 0, which is where the regression
    puts it, and the places midway between two margins at which at most ``false_rate`` of the clean ones are
    rejected; of equally good ones the nearest to 0 is taken."""
    values = np.unique(margin)
    places = np.r_[0.0, values[0] - 1, (values[1:] + values[:-1]) / 2, values[-1] + 1]
    above = lambda mine: 1 - np.searchsorted(np.sort(margin[mine]), places, "right") / mine.sum()
    toxic, clean = above(y == 1), above(y == 0)
    gain = np.where((clean <= false_rate) | (np.arange(len(places)) == 0), toxic - clean, -np.inf)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(places[best[np.argmin(np.abs(places[best]))]])


def train(labelled: DataFrame, max_training: int = MAX_TRAINING,
          settings: tuple[tuple[float, float], ...] = SETTINGS, false_rate: float = FALSE_RATE) -> Model:
    """Learn from ``labelled``: ``text``, ``label`` (0 or 1), ``key`` (any integer, which with the
    text picks the rows of the bounded sample and of the folds). Without rows of both classes, all texts get
    score 0 (1, if all rows have label 1)."""
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 30.0 if n1 else -30.0)
    half = max_training // 2
    take1 = min(n1, max(half, max_training - n0))
    take0 = min(n0, max_training - take1)
    mark = F.xxhash64("key", "text").bitwiseAND(F.lit(2 ** 63 - 1)).alias("mark")
    # The training texts pass by once; the rest is read from what that pass has written.
    seen = materialize(labelled.select("text", "label", mark).mapInArrow(
        _count((1.1 * take0 / n0, 1.1 * take1 / n1)),
        ", ".join(["feature int", *(f"{c} long" for c in _COUNTS), "text string, label int, mark long"])), "toxicity-training")
    found = (seen.where("feature IS NOT NULL").groupBy("feature")
             .agg(*(F.sum(c).alias(c) for c in _COUNTS)).toArrow())  # at most 2 ** BITS rows
    counts = np.zeros((FOLDS, 2, 1 << BITS))
    for i, name in enumerate(_COUNTS):
        counts[i // 2, i % 2, found.column("feature").to_numpy()] = found.column(name).to_numpy()

    chosen = seen.where("mark IS NOT NULL").select("text", "label", "mark")
    sample = (chosen.where("label = 1").orderBy("mark", "text").limit(take1)
              .union(chosen.where("label = 0").orderBy("mark", "text").limit(take0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [zlib.compress(_bits(present(text, ORDERS, BITS)), 1) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *batch.columns[1:]], ["bits", "label", "fold"])

    packed = materialize(sample.select("text", "label", (F.col("mark") % FOLDS).cast("int").alias("fold")).repartition(16)
                         .mapInArrow(pack, "bits binary, label int, fold int"), "toxicity-sample")
    shared = labelled.sparkSession.sparkContext.broadcast(counts)  # 2 ** BITS numbers for each fold and class

    def scales_of(folds: list[int], smoothing: float) -> np.ndarray:
        """Of all training rows in these folds."""
        share = len(folds) / FOLDS
        return log_count_ratio(*shared.value[folds].sum(axis=0), n0 * share, n1 * share, smoothing * share)

    def unseen(key: tuple, rows: pa.Table) -> pa.Table:
        """Margins of a fold's rows, for each setting, by a model of the other folds."""
        label, fold, bits = _sorted_group(rows)
        own = key[0].as_py()
        mine, others, out = fold == own, [k for k in range(FOLDS) if k != own], []
        for number, (smoothing, penalty) in enumerate(settings):
            scales = scales_of(others, smoothing)
            one, two = (_Rows([b for b, m in zip(bits, side) if m], scales) for side in (~mine, mine))
            at = _fit(one, label[~mine], penalty, STEPS)
            out.append(pa.table([label[mine], np.full(mine.sum(), number), two.times(at[:-1]) + at[-1]],
                                ["label", "setting", "margin"]))
        return pa.concat_tables(out)

    def whole(smoothing: float, penalty: float):
        def run(rows: pa.Table) -> pa.Table:
            label, _, bits = _sorted_group(rows)
            rows = _Rows(bits, scales_of(list(range(FOLDS)), smoothing))
            return pa.table([[_fit(rows, label, penalty, STEPS).tobytes()]], ["at"])
        return run

    # A task for each fold and one for the whole bounded sample; the driver gets margins and weights.
    setting, move = settings[0], 0.0
    size = {(r["label"], r["fold"]): r["n"] for r in packed.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    if len(size) == 2 * FOLDS and min(sum(n for (c, _), n in size.items() if c == label) for label in (0, 1)) >= FEW:
        models = packed.withColumn("model", F.explode(F.array(*map(F.lit, range(FOLDS)))))
        tried = models.groupBy("model").applyInArrow(unseen, "label double, setting long, margin double").toPandas()
        best = np.inf
        for number, rows in tried.groupby("setting"):
            y, margin = rows["label"].to_numpy(), rows["margin"].to_numpy()
            loss = np.logaddexp(0, np.where(y == 1, -margin, margin))
            if (mean := loss[y == 1].mean() + loss[y == 0].mean()) < best:
                best, setting, move = mean, settings[number], threshold(y, margin, false_rate)
    at = np.frombuffer(packed.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(whole(*setting), "at binary").first()["at"])
    scales = log_count_ratio(*counts.sum(axis=0), n0, n1, setting[0])
    return Model(scales, at[:-1] * scales, float(at[-1]) - move)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1; higher: label 1 likelier). Null
    and empty texts are scored by the bias alone. Rows and other columns stay as they are;
    a column named ``out_col`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out_col]
    schema = docs.select(*kept).schema.add(out_col, "double")
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            scores = pa.array([judge.score(t) for t in batch.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*kept, out_col])

    return docs.select(*kept).mapInArrow(run, schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """Training rows: documents with a label (of several, the largest; null ones don't
    count) for which ``held_out`` (a condition on doc_id) is false."""
    known = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("label")).where(~held_out))
    # Labels grow with the documents: a shuffle join at every size.
    return docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("text", "label", F.col("doc_id").alias("key"))
