"""Language identification by the nearest of several centroids a language.

Texts become sparse TF-IDF vectors over hashed character n-grams (runs of other signs than letters
count as one space), scaled to length one. Document
frequencies are counted over all training rows. Each language's vectors (a bounded sample, at least one row of every
language) are clustered by cosine, and a text gets the language of the centroid nearest to it. A text farther from it than the
language's own texts of that size are is rejected: limits are learned for each language, by the number of distinct
n-grams, since long texts lie nearer to every centroid than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ngrams import hashed

ORDERS, BITS = (1, 2, 3), 18
CLUSTERS, ROUNDS = 3, 12
#: Training rows that are clustered, over all languages; one for each language more, so that none is left out.
MAX_TRAINING = 4_000
#: Languages whose row counts are broadcast (some 40 bytes each); beyond that the planner chooses the join.
FEW_LANGUAGES = 100_000
#: Part of the least similarity of a language's own texts below which a text is rejected; bands of sizes (powers of two).
SLACK, BANDS = 0.7, 24
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bucket numbers of a text, ascending, and how often each occurs."""
    parts = list(hashed(text, ORDERS, BITS, letters=True))
    if sum(map(len, parts)) < 1 << (BITS - 5):
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    out = np.zeros(1 << BITS, np.int64)
    for part in parts:
        out += np.bincount(part, minlength=1 << BITS)
    found = np.flatnonzero(out).astype(np.int32)
    return found, out[found]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = counts_of(text)
    out = np.log1p(n) * idf[found]
    return found, out / (np.linalg.norm(out) or 1.0)


def band(size: int) -> int:
    return min(int(size).bit_length(), BANDS - 1)


class _Sparse:
    """Rows of sparse vectors, over the buckets that any of them has."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.starts = np.cumsum([0] + [len(i) for i, _ in rows])
        self.used, self.at = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
        self.values = np.concatenate([v for _, v in rows]).astype(float)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.starts))

    def times(self, centre: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * centre[self.at], len(self.starts) - 1)

    def mean(self, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.values * chosen[self.row], len(self.used)) / chosen.sum()


def clusters(rows: _Sparse, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length one by k-means with cosine. The first is the mean; each further
    one starts from the vector farthest from those before it."""
    one = lambda c: c / (np.linalg.norm(c) or 1.0)
    n = len(rows.starts) - 1
    centres = [one(rows.mean(np.ones(n)))]
    while len(centres) < min(k, n):
        near = np.max([rows.times(c) for c in centres], axis=0)
        centres.append(one(rows.mean(np.arange(n) == near.argmin())))
    for _ in range(rounds):
        own = np.argmax([rows.times(c) for c in centres], axis=0)
        centres = [one(rows.mean(own == i)) if (own == i).any() else c for i, c in enumerate(centres)]
    return np.stack(centres)


@dataclass
class Model:
    """Centroids as a table by bucket: those of bucket f are ``of[starts[f]:starts[f + 1]]``, with ``weights``. ``limits``
    has the least similarity that is not rejected, by language and band."""
    idf: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    weights: np.ndarray
    languages: list[str]  # of each centroid
    limits: dict[str, np.ndarray]

    def similarities(self, found: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of a vector with each centroid."""
        sizes = self.starts[found + 1] - self.starts[found]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[found] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.of[at], self.weights[at] * np.repeat(values, sizes), len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Nearest language, cosine similarity (0 to 1) and whether it is rejected; ``und``, 0.0 for a text that is
        null or has no letter, or if nothing was learned."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        found, values = vector(text, self.idf)
        near = self.similarities(found, values)
        best = int(near.argmax())
        name, score = self.languages[best], float(min(max(near[best], 0.0), 1.0))
        return name, score, score < self.limits[name][band(len(found))]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            out[counts_of(text)[0]] += 1
    used = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], ["feature", "n"])


def _limits(similar: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each band: a part of the least similarity of the language's own texts of that size or a smaller one that
    was seen (of the next larger, below the smallest)."""
    bands = np.array([band(n) for n in sizes])
    least = {b: similar[bands == b].min() for b in set(bands.tolist())}
    seen = sorted(least)
    return np.array([SLACK * least[max((b for b in seen if b <= i), default=seen[0])] for i in range(BANDS)])


def train(labelled: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """Learn from ``labelled``: ``text``, ``lang`` (not null), ``key`` (any integer, which picks
    the bounded sample). Texts without a letter teach nothing. Every language that is left gets a centroid."""
    rows = (labelled.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
            .select("lang", "text", F.xxhash64("key", "text").alias("mark")))
    totals = materialize(rows.groupBy("lang").agg(F.count("*").alias("total"), F.min("mark").alias("first")), "languages")
    languages, n = totals.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not n:
        return Model(np.zeros(1 << BITS), np.zeros((1 << BITS) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0), [], {})
    found = (rows.select("text").mapInArrow(_frequencies, "feature int, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())  # at most 2 ** BITS rows
    seen = np.zeros(1 << BITS)
    seen[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + n) / (1 + seen)) + 1

    # A row is picked by its hash, at a rate that gives each language its part of the sample; the first row always.
    quota = max(1, max_training // languages)
    place = F.pmod("mark", F.lit(1 << 30)) / float(1 << 30)
    first = F.col("mark") == F.col("first")
    known = F.broadcast(totals) if languages <= FEW_LANGUAGES else totals
    sample = materialize(rows.join(known, "lang").where(first | (place * F.col("total") < 0.95 * quota))
                         .select("lang", "text", "mark", first.alias("first"))
                         .orderBy(F.desc("first"), "mark", "text").limit(max_training + languages), "language-sample")
    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [vector(t, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i for i, _ in out], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in out], pa.list_(pa.float32()))], ["lang", "found", "weights"])

    def centroids(group: pa.Table) -> pa.Table:
        """Of a language's rows, which are at most the sample."""
        pairs = sorted(((i.values.to_numpy(), v.values.to_numpy().astype(float)) for i, v in zip(
            group.column("found").combine_chunks(), group.column("weights").combine_chunks())), key=lambda p: (p[0].tobytes(), p[1].tobytes()))
        rows = _Sparse(pairs)
        centres = clusters(rows)
        near = np.max([rows.times(c) for c in centres], axis=0)
        limits = _limits(near, np.diff(rows.starts))
        out = [(rows.used[c != 0].astype(np.int32), c[c != 0].astype(np.float32)) for c in centres]
        return pa.table([pa.array([group.column("lang")[0].as_py()] * len(out), pa.string()),
                         pa.array([i for i, _ in out], pa.list_(pa.int32())), pa.array([w for _, w in out], pa.list_(pa.float32())),
                         pa.array([limits] * len(out), pa.list_(pa.float64()))], ["lang", "found", "weights", "limits"])

    packed = sample.select("lang", "text").repartition(16).mapInArrow(vectors, "lang string, found array<int>, weights array<float>")
    # The model: of each language at most ``CLUSTERS`` centroids, which have no more n-grams than the sample.
    rows = packed.groupBy("lang").applyInArrow(centroids, "lang string, found array<int>, weights array<float>, limits array<double>").toArrow()
    names = rows.column("lang").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], i))
    lists = [rows.column("found")[i].values.to_numpy() for i in order]
    bucket = np.concatenate(lists)
    by_bucket = np.argsort(bucket, kind="stable")
    return Model(idf, np.r_[0, np.cumsum(np.bincount(bucket, minlength=1 << BITS))],
                 np.repeat(np.arange(len(order), dtype=np.int32), [len(x) for x in lists])[by_bucket],
                 np.concatenate([rows.column("weights")[i].values.to_numpy() for i in order]).astype(float)[by_bucket],
                 [names[i] for i in order], {names[i]: np.array(rows.column("limits")[i].as_py()) for i in order})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (the nearest language; ``und`` for texts that are null or
    have no letter), ``score`` (cosine similarity, 0 to 1) and ``rejected`` (the text is farther from the language's
    centroids than its own texts of that size are, or it is ``und``).

    Ties go to the language first in code point order. Rows and other columns stay as they
    are; columns of these three names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(place).to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*kept, "lang_pred", "score", "rejected"])

    return docs.select(*kept).mapInArrow(run, schema)
