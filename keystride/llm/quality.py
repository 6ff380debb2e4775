"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a few statistics of its characters, words and lines. Standardized, they pass
through cosines of random projections, whose products approximate a Gaussian kernel. Every partition
of the labelled sample sums its part of the normal equations; the sums, of fixed size, are added and
solved on the driver. A part of the sample is kept out of the solution and calibrates the raw values:
counts per bin are pooled until the share of label 1 never falls (pool adjacent violators).

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids;
label rows with a null are left out, and an id with several labels takes the smallest. Without rows of
both labels every score is the share of label 1, or 0.5 without labels. Null and empty texts have all
statistics zero and are scored like others.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import bounded_sample, map_columns
from keystride.session import materialize

SAMPLE = 20_000        # labelled rows the model is fitted on, at most
FIT_PARTITIONS = 16    # partial sums that reach the driver, at most
FEATURES = 256         # random Fourier features
RIDGE = 1e-3           # penalty per row
WIDTH = 1.0            # of the kernel, in units of the root of the number of statistics
BINS = 200             # of the calibration
CALIBRATE = 4          # one labelled row in so many calibrates
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SPACE = b"\t\n\x0b\x0c\r "
_MARKS = bytes(b for b in range(33, 127) if chr(b) not in "'-.,;:?" and not chr(b).isalnum())
STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; shares lie between 0 and 1, sizes are logarithms."""
    if not text:
        return [0.0] * STATISTICS
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split("\n") if x]
    line_counts = Counter(lines)
    upper, lower, digits, spaces, marks = map(without, (_UPPER, _LOWER, _DIGIT, _SPACE, _MARKS))
    letters = max(1, upper + lower)
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = octets[octets > 0] / size
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(size / n), upper / letters, digits / size,
        spaces / size, marks / size, without(b".,;:?") / size, raw.count(b"|") / n, raw.count(b"!!") / n,
        len(counts) / n, top / n, sum(map(eq, words, words[1:])) / n,
        len(line_counts) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        float(-(shares * np.log2(shares)).sum()), (size - len(text)) / size,
    ]


@dataclass
class Model:
    """All that scoring needs: some thousand numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray     # raw values at which calibrated scores are given
    levels: np.ndarray    # never falling

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def pool_adjacent(values: list[float], weights: list[float]) -> list[float]:
    """The closest never falling sequence, in weighted squares."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in pools for _ in range(n)]


def constant_model(share: float) -> Model:
    return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(2),
                 np.zeros(1), np.array([share]))


def _add_up(parts: DataFrame, size: int) -> np.ndarray:
    total = np.zeros(size)
    # One row of fixed size per partition, FIT_PARTITIONS at most.
    for row in parts.toLocalIterator():
        total += np.frombuffer(row.part, dtype=np.float64)
    return total


def partition_sums(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of the sample: each partition sums its own, the driver adds the sums."""
    n = len(model.weights)

    def run(batches):
        gram, right = np.zeros((n, n)), np.zeros(n)
        for rows in batches:
            stats = np.stack(rows.column("stats").to_numpy(zero_copy_only=False)) if rows.num_rows else np.empty((0, STATISTICS))
            if len(stats):
                z = model.fourier(stats)
                gram += z.T @ z
                right += z.T @ rows.column("label").to_numpy(zero_copy_only=False)
        part = np.concatenate([gram.ravel(), right]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    total = _add_up(sample.select("stats", "label").mapInArrow(run, "part binary"), n * n + n)
    return total[:n * n].reshape(n, n), total[n * n:]


def _calibration(held: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        sums = np.zeros((2, BINS))
        for rows in batches:
            if rows.num_rows:
                raw = model.raw(np.stack(rows.column("stats").to_numpy(zero_copy_only=False)))
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)  # raw values lie around 0 to 1
                np.add.at(sums[0], at, 1.0)
                np.add.at(sums[1], at, rows.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["part"])

    seen, ones = _add_up(held.select("stats", "label").mapInArrow(run, "part binary"), 2 * BINS).reshape(2, BINS)
    used = seen > 0
    levels = pool_adjacent((ones[used] / seen[used]).tolist(), seen[used].tolist())
    centres = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    return centres[used], np.array(levels)


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))]

        return compute

    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, "stats array<double>", make)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, features: int = FEATURES, seed: int = 11) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (``doc_id``, ``label``) names."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.min(label).cast("double").alias("label"))
    chosen = bounded_sample(marks, "_id", sample)
    named = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    # At most ``sample`` small rows.
    found = named.join(F.broadcast(chosen), "_id").select("_id", "_text", "label")
    used = materialize(with_statistics(found, ["_id", "label"], "_text").repartition(FIT_PARTITIONS, "_id"))
    row = used.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *[
        f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    if not row.n or not 0 < row.ones < row.n:
        return constant_model(row.ones / row.n if row.n else 0.5)
    draw = np.random.default_rng(seed)
    model = Model(
        np.array([row[f"m{i}"] for i in range(STATISTICS)]),
        np.array([row[f"s{i}"] if row[f"s{i}"] > 1e-9 else 1.0 for i in range(STATISTICS)]),
        draw.normal(size=(STATISTICS, features)) / (WIDTH * np.sqrt(STATISTICS)),
        draw.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1),
    )
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "_id"), F.lit(CALIBRATE)) == 0
    gram, right = partition_sums(used.where(~held), model)
    rows = max(1.0, gram[-1, -1])
    model.weights = np.linalg.solve(gram + RIDGE * rows / 100 * np.eye(len(right)), right)
    edges, levels = _calibration(used.where(held), model)
    if not len(edges):
        edges, levels = _calibration(used, model)
    model.edges, model.levels = edges, levels
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns, ``score double`` and ``predicted int``."""
    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            scores = model.score(np.array([statistics(t.as_py()) for t in texts]))
            return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

        return compute

    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, "score double, predicted int", make)
