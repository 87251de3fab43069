"""Quality scores: kernel ridge on document statistics by random Fourier features.

A text becomes some two dozen statistics of its characters, words and lines, some
of them of its worst passage. Random Fourier features of these approximate a
Gaussian kernel, so ridge regression on them is a kernel machine whose normal
equations have a fixed size: every task sums its rows' part and Spark adds the
parts up. An isotonic curve, fitted on rows that the regression has not seen,
turns its values into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .shared import partitions, scratch, settled

FEATURES = 256
#: Width of the kernel in standard deviations of a statistic, times the root of
#: the number of statistics.
WIDTH = 1.0
RIDGE = 1e-3
GOOD = 0.7
#: One labelled row in so many calibrates, the others are regressed on.
CALIBRATE = 4
#: Values are calibrated in steps of 1/STEPS from LOW to HIGH.
STEPS, LOW, HIGH = 500, -1.0, 2.0
#: Words of a passage.
PASSAGE = 32
FAR = 5.0

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower case, 2 upper case, 3 digit, 4 stop, 5 other sign, 6 first byte of a longer character, 7 its other bytes
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[33:48] = 1, 2, 3, 5
_CLASS[[58, 59, 60, 61, 62, 63, 64, *range(91, 97), *range(123, 127)]] = 5
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4
_CLASS[128:192], _CLASS[192:] = 7, 6
STATISTICS = (
    "chars", "words", "lines", "word_bytes", "word_spread", "upper", "digits", "stops", "signs", "wide", "line_words", "one_word_lines", "lines_repeated", "words_repeated", "word_variety",
    "shouted", "signed", "bare_signs", "worst_shouted", "worst_signed", "worst_bare_signs", "worst_repeated", "worst_digits", "long_words", "doubled_stops",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x ``STATISTICS`` of texts end to end (an empty text: zeros)."""
    rows = len(offsets) - 1
    kind = _CLASS[data]
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    count = lambda mask: np.bincount(row_of_byte[mask], minlength=rows).astype(float)
    chars = count(kind != 7)
    starts, ends, first = A.words(data, offsets)
    n = np.diff(first).astype(float)
    row = A.rows_of(first)
    size = (ends - starts).astype(float)
    hashed = A.word_hashes(data, starts, ends)
    per_row = lambda v: np.bincount(row, v, rows)
    share = lambda v, of: v / np.maximum(of, 1)

    def inside(mask):
        """Bytes of a mask in each word."""
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[ends] - sums[starts]

    up, low, signs, digits, stops = (inside(kind == k) for k in (2, 1, 5, 3, 4))
    letters = up + low
    shouted = (up >= 2) & (low == 0)
    signed = (signs >= 2) | (inside((kind == 4) & (np.append(kind[1:], 0) == 4)) >= 1)
    bare = (letters == 0) & (inside(kind >= 6) == 0) & (signs > 0)
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (hashed[1:] == hashed[:-1])
    order = np.lexsort((hashed, row))
    r, h = row[order], hashed[order]
    fresh = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))[: len(r)]
    variety = np.bincount(r[fresh], minlength=rows)

    # passages: PASSAGE words of a row in turn, the last one with the rest
    place = np.arange(len(row)) - first[:-1][row]
    group = place // PASSAGE
    opens = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))[: len(row)])
    length = np.diff(np.append(opens, len(row)))

    def worst(mask):
        out = np.zeros(rows)
        if len(opens):
            # short passages count against half a passage, so that one odd word is no odd passage
            np.maximum.at(out, row[opens], np.add.reduceat(mask.astype(float), opens) / np.maximum(length, PASSAGE // 2))
        return out

    # lines: runs of bytes between newlines that hold a word
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts]
    begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (line[1:] != line[:-1]))[: len(row)])
    in_line = np.diff(np.append(begins, len(row)))
    line_row = row[begins]
    lines = np.bincount(line_row, minlength=rows).astype(float)
    line_place = np.arange(len(row)) - np.repeat(begins, in_line)
    mixed = A.mix(hashed + A.odd_factors(int(line_place.max()) + 1 if len(row) else 1, 31)[line_place])
    line_hash = np.add.reduceat(mixed, begins) if len(begins) else mixed
    order = np.lexsort((line_hash, line_row))
    r, h = line_row[order], line_hash[order]
    fresh = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))[: len(r)]
    distinct_lines = np.bincount(r[fresh], minlength=rows)

    mean = share(per_row(size), n)
    spread = np.sqrt(np.maximum(share(per_row(size * size), n) - mean**2, 0))
    doubled = count((kind == 4) & (np.append(kind[1:], 0) == 4)) if len(kind) else np.zeros(rows)
    latin = count((kind == 1) | (kind == 2))
    columns = [
        np.log1p(chars), np.log1p(n), np.log1p(lines), mean, spread, share(count(kind == 2), latin), share(count(kind == 3), chars), share(count(kind == 4), chars), share(count(kind == 5), chars), share(count(kind == 6), chars),
        np.log1p(share(n, lines)), share(np.bincount(line_row, in_line == 1, rows), lines), 1 - share(distinct_lines, lines) * (lines > 0) - (lines == 0), share(per_row(again), n), share(variety, n**0.8),
        share(per_row(shouted), n), share(per_row(signed), n), share(per_row(bare), n), worst(shouted), worst(signed), worst(bare), worst(again), worst(digits > 0), share(per_row(size > 20), n), share(doubled, chars),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Kernel:
    """The fixed part of a model: how statistics become Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 23) -> Kernel:
        rng = np.random.default_rng(seed)
        k = len(mean)
        return cls(mean, scale, rng.standard_normal((k, features)) / (width * k**0.5), rng.uniform(0, 2 * np.pi, features))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Rows whose products approximate exp(-|a - b|^2 / (2 width^2 k)); the last feature is 1."""
        z = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        waves = np.cos(z @ self.weights + self.shift) * (2 / len(self.shift)) ** 0.5
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)


@dataclass
class Model:
    kernel: Kernel
    coefficients: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.coefficients

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; a thousandth of the raw value keeps the
        order of rows inside a step of the isotonic curve. Rounded, because sums
        of products differ in their last digits with the rows beside them."""
        raw = np.clip(self.raw(x), LOW, HIGH)
        return np.clip(0.999 * np.interp(raw, self.knots, self.heights) + 0.001 * (raw - LOW) / (HIGH - LOW), 0, 1).round(9)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and heights of the ascending curve nearest to ``mean`` (at ascending
    ``at``) by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []  # height, weight, first, last
    for a, m, w in zip(at, mean, weight):
        blocks.append([m, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, begin, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, begin, last])
    return np.array([x for b in blocks for x in b[2:]]), np.array([b[0] for b in blocks for _ in (0, 1)])


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; rows without an id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics (array) of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            for i, j in A.slices(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def normal_equations(rows: DataFrame, kernel: Kernel, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over ``rows`` (stats, y). Every task sums its rows' part; the
    parts' lines are added up by line number, so that what reaches the driver
    is one matrix, whatever the number of tasks."""
    size = len(kernel.shift) + 1

    def part(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, y = _matrix(batch.column("stats")), batch.column("y").to_numpy()
            for a in range(0, len(x), 4096):
                z = kernel.features(x[a : a + 4096])
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ y[a : a + 4096]
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "sums"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy().reshape(-1, size + 1)
            for line, values in zip(batch.column("line").to_pylist(), sums):
                total[line] = total[line] + values if line in total else values.copy()
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["line", "sums"])

    schema = "line long, sums array<double>"
    lines = rows.select("stats", "y").mapInArrow(part, schema).repartition(min(parts, size), "line").mapInArrow(added, schema).collect()
    whole = np.zeros((size, size + 1))
    for r in lines:
        whole[r["line"]] += r["sums"]
    return whole[:, :-1], whole[:, -1]


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """A model of the labels (doc_id, y: 0 or 1) that are not held out over
    ``stats`` (files); None where nothing is labelled. All of those rows count; where
    only few calibrate, all do."""
    parts = partitions(stats.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("y").cast("double").alias("y"))
    with scratch(stats.sparkSession) as save:
        rows = save(stats.join(known, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(CALIBRATE)) == 0).alias("calibrates")))
        n, held = rows.agg(F.count(F.lit(1)), F.sum(F.col("calibrates").cast("long"))).first()
        if not n:
            return None
        k = range(len(STATISTICS))
        moments = stats.agg(*(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in k), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in k)).first()
        kernel = Kernel.drawn(np.array([moments[f"m{i}"] for i in k]), np.maximum([moments[f"s{i}"] for i in k], 1e-6), features)
        few = held < 200 or n - held < 200
        ztz, zty = normal_equations(rows if few else rows.where("NOT calibrates"), kernel, parts)
        penalty = ridge * (n if few else n - held) * np.eye(len(zty)) / len(zty)
        penalty[-1, -1] = 1e-9
        coefficients = np.linalg.solve(ztz + penalty, zty)
        bare = Model(kernel, coefficients, np.zeros(1), np.zeros(1))

        def steps(batches):
            for batch in batches:
                raw = np.clip(bare.raw(_matrix(batch.column("stats"))), LOW, HIGH)
                yield pa.record_batch([pa.array(np.floor((raw - LOW) * STEPS).astype(np.int64)), batch.column("y")], ["step", "y"])

        curve = (rows if few else rows.where("calibrates")).select("stats", "y").mapInArrow(steps, "step long, y double")
        points = curve.groupBy("step").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()  # at most (HIGH - LOW) * STEPS + 1
        at = LOW + (np.array([p["step"] for p in points]) + 0.5) / STEPS
        knots, heights = isotonic(at, np.array([p["y"] for p in points]), np.array([p["n"] for p in points], float))
        return Model(kernel, coefficients, knots, heights)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1,
    higher: label 1 likelier), predicted (1 from ``GOOD`` up).

    ``labels``: doc_id and quality; null labels and ids and those held out teach
    nothing; a doc_id's repeated or contradicting labels count each. Null and
    empty texts have statistics of 0 and the score these come to. Repeated rows
    and equal texts have equal scores. Without any label the score is 0.5.
    Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession) as save:
        stats = save(measured(docs))
        model = fit(stats, labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y")))

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("stats"))
                score = model.scores(x) if model else np.full(len(x), 0.5)
                yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], ["doc_id", "score", "predicted"])

        out = stats.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
        return settled(out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))
