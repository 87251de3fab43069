"""Toxicity by class-conditional Kneser-Ney models over the bytes of texts.

Two models of order ``ORDER``, one of toxic and one of ordinary texts, give the
likelihood of every byte behind the bytes before it. Words follow each other
with one blank between them, and contexts reach over it, so expressions of
several words have their own counts. The higher orders have counts of each
class; where a class has not seen a context it backs off, down to pairs and
single bytes, whose continuation counts both classes share. So an expression
that one class has hardly seen is judged by what all texts have in common.

A text's score compares its two log-likelihoods, normalised by length: over the
whole text, and over its passages of each length in ``PASSAGES`` (in words), of
which the most toxic one speaks, so that a few toxic words in a long text count.
A logistic curve, calibrated on labelled texts that are not counted, turns these
comparisons into a number from 0 to 1.

Tasks add up their n-grams, Spark adds up the tasks. The counts are exact Spark
tables that grow with the corpus; no task holds them whole. Texts are scored in
blocks: the distinct n-grams of all blocks are joined with the tables, their
ratios are joined back to the blocks, and a block meets its own n-grams only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .langid import held_out
from .shared import scratch, settled, veiled

ORDER = 5
LOWEST = 3  # below, the classes share their counts
PASSAGES = (1, 4)
BLOCK_BYTES = 64_000_000
PARCEL_BYTES = 8_000_000
DISCOUNT = 0.75
#: Bound of the labelled rows that calibrate the score (they are not counted).
CALIBRATION_ROWS = 30_000
#: More labels than this are not sent to all tasks; the texts are shuffled to them.
BROADCAST_LABELS = 200_000
_MASK = [(1 << (8 * k)) - 1 for k in range(9)]
_BLANK = 32  # fixed value: what stands between words, and before the first


@dataclass
class Stream:
    """Rows as words that are each followed by a blank, A-Z as a-z: the n-gram
    (``ORDER`` bytes as a number) that ends at each byte, where words start, and
    the rows' first words and first bytes (n + 1 entries each)."""

    gram: np.ndarray
    word: np.ndarray
    first_word: np.ndarray
    first_byte: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Stream:
        starts, ends, first = A.words(data, offsets)
        size = ends - starts + 1
        at = np.concatenate([[0], np.cumsum(size)])
        body = np.full(int(at[-1]), _BLANK, np.int64)
        letters = np.ones(len(body), bool)
        letters[at[1:] - 1] = False
        body[letters] = data[np.repeat(starts, size - 1) + A.ramp(size - 1)]
        body[(body >= 65) & (body <= 90)] += 32
        first_byte = at[first]
        within = np.arange(len(body)) - np.repeat(first_byte[:-1], np.diff(first_byte))
        gram = body.copy()
        for back in range(1, ORDER):
            before = np.full(len(body), _BLANK, np.int64)
            before[back:] = np.where(within[back:] >= back, body[:-back], _BLANK)
            gram |= before << (8 * back)
        return cls(gram, at[:-1], first, first_byte)


def _compact(grams: list, zero: list, one: list):
    import pandas as pd

    at, keys = pd.factorize(np.concatenate(grams))
    return [keys], [np.bincount(at, np.concatenate(zero), len(keys))], [np.bincount(at, np.concatenate(one), len(keys))]


def count_ngrams(rows: DataFrame) -> DataFrame:
    """``rows`` (text, toxic) to g, n0, n1: each n-gram's count per class."""

    def run(batches):
        grams, zero, one, held = [], [], [], 0

        def emit():
            (g,), (a,), (b,) = _compact(grams, zero, one)
            for k in range(0, len(g), 100_000):
                yield pa.record_batch([pa.array(x[k : k + 100_000].astype(np.int64)) for x in (g, a, b)], ["g", "n0", "n1"])

        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            for i, j in A.slices(offsets):
                own = Stream.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kind = np.repeat(toxic[i:j], np.diff(own.first_byte)).astype(np.float64)
                (g,), (a,), (b,) = _compact([own.gram], [1 - kind], [kind])
                grams.append(g)
                zero.append(a)
                one.append(b)
                held += len(g)
                if held > 4_000_000:
                    grams, zero, one = _compact(grams, zero, one)
                    held = len(grams[0])
                    if held > 2_000_000:
                        yield from emit()
                        grams, zero, one, held = [], [], [], 0
        if held:
            yield from emit()

    return rows.select("text", "toxic").mapInArrow(run, "g long, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class Model:
    """Per order k from ``LOWEST``: ``count[k]`` (g, n0, n1) and ``context[k]``
    (c, t0, t1, y0, y1: a context's total and its types per class); ``pair``
    (65,536 shared probabilities)."""

    count: dict[int, DataFrame]
    context: dict[int, DataFrame]
    pair: np.ndarray
    weights: np.ndarray

    def gram_ratios(self, grams: DataFrame) -> DataFrame:
        """``grams`` (g, distinct) with ratio: the log-likelihood ratio (toxic to
        ordinary) of an n-gram's last byte behind the others."""
        table = pa.table({"low": np.arange(65_536), "p0": self.pair, "p1": self.pair})
        p = grams.sparkSession.createDataFrame(table)
        for k in range(LOWEST, ORDER + 1):
            own = grams.select(F.col("g").bitwiseAND(F.lit(_MASK[k])).alias("g")).distinct()
            own = own.select("g", F.shiftright("g", 8).alias("c"), F.col("g").bitwiseAND(F.lit(_MASK[k - 1])).alias("low"))
            found = own.join(p, "low").join(self.count[k], "g", "left").join(self.context[k], "c", "left")

            def step(x):
                n, t, y = (F.coalesce(f"{c}{x}", F.lit(0)) for c in "nty")
                seen = (F.greatest(n - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT) * y * F.col(f"p{x}")) / t
                return F.when(t > 0, seen).otherwise(F.col(f"p{x}")).alias(f"p{x}")

            p = found.select(F.col("g").alias("low"), step(0), step(1))
        return p.select(F.col("low").alias("g"), (F.log("p1") - F.log("p0")).alias("ratio"))

    def byte_ratios(self, text: str) -> np.ndarray:
        """Log-likelihood ratio (toxic to ordinary) at each byte of one text's stream."""
        data = np.frombuffer(text.encode(), np.uint8)
        gram = Stream.of(data, np.array([0, len(data)])).gram
        spark = self.count[ORDER].sparkSession
        known = Ratios.of(self.gram_ratios(spark.createDataFrame(pa.table({"g": np.unique(gram)}))).toArrow())
        return known.at(gram)


@dataclass
class Ratios:
    """The ratios of some n-grams, sorted by n-gram."""

    g: np.ndarray
    ratio: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Ratios:
        g, first = np.unique(rows.column("g").to_numpy(), return_index=True)
        return cls(g, rows.column("ratio").to_numpy()[first])

    def at(self, gram: np.ndarray) -> np.ndarray:
        import pandas as pd

        code, distinct = pd.factorize(gram)
        if not len(distinct):
            return np.zeros(0)
        where = np.minimum(np.searchsorted(self.g, distinct), len(self.g) - 1)
        if not len(self.g) or (self.g[where] != distinct).any():
            raise AssertionError("a block without the ratios of its n-grams")
        return self.ratio[where][code]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row: the mean ratio per byte of the text, then for each length in
        ``PASSAGES`` that of its most toxic passage of so many words (or of the
        whole text, where it has fewer). A row without words has zeros."""
        own = Stream.of(data, offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.at(own.gram))])
        n, out = np.diff(own.first_word), np.zeros((len(offsets) - 1, 1 + len(PASSAGES)))
        full = np.flatnonzero(n)
        a, b = own.first_byte[full], own.first_byte[full + 1]
        out[full] = ((sums[b] - sums[a]) / (b - a))[:, None]
        ends = np.append(own.word[1:], own.first_byte[-1])
        for column, words in enumerate(PASSAGES, 1):
            row = np.flatnonzero(n >= words)
            if len(row):
                start = np.repeat(own.first_word[row], n[row] - words + 1) + A.ramp(n[row] - words + 1)
                begin, end = own.word[start], ends[start + words - 1]
                mean = (sums[end] - sums[begin]) / (end - begin)
                out[row, column] = np.maximum.reduceat(mean, np.cumsum(n[row] - words + 1) - (n[row] - words + 1))
        return out


FEATURES = [f"f{k}" for k in range(1 + len(PASSAGES))]


def scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_expand(features) @ weights, -40, 40)))


def _expand(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), 10 * f[:, 0], f[:, 1:]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: DataFrame, calibration: DataFrame, save) -> Model:
    """A model of ``rows`` (text, toxic), its score calibrated on ``calibration``,
    whose features (a few numbers a row, of a bounded sample) reach the driver."""
    table = settled(count_ngrams(rows))
    count, context = {}, {}
    for k in range(ORDER, LOWEST - 1, -1):
        count[k] = table
        seen = [F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count_if(F.col("n0") > 0).alias("y0"), F.count_if(F.col("n1") > 0).alias("y1")]
        context[k] = settled(table.groupBy(F.shiftright("g", 8).alias("c")).agg(*seen))
        # continuation counts: how many longer n-grams end so
        shorter = F.col("g").bitwiseAND(F.lit(_MASK[k - 1]))
        table = settled(table.groupBy(shorter.alias("g")).agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")))
    shared = np.zeros((256, 256))
    pairs = table.select("g", (F.col("n0") + F.col("n1")).alias("n")).toArrow()  # at most 65,536 rows
    if pairs.num_rows:
        shared.reshape(-1)[pairs.column(0).to_numpy()] = pairs.column(1).to_numpy()
    single = ((shared > 0).sum(axis=0) + 1.0) / ((shared > 0).sum() + 256)
    sums, kinds = shared.sum(axis=1, keepdims=True), (shared > 0).sum(axis=1, keepdims=True)
    pair = np.where(sums > 0, (np.maximum(shared - DISCOUNT, 0) + DISCOUNT * kinds * single) / np.maximum(sums, 1), single)
    model = Model(count, context, pair.reshape(-1), np.array([-3.0, 1.0, *[1.0] * len(PASSAGES)]))
    learned = _features(save(calibration.select("toxic", "text")), model, ["toxic"], save).drop("score").toArrow()
    y = learned.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        f = np.column_stack([learned.column(c).to_numpy() for c in FEATURES])
        model.weights = logistic(_expand(f), y)
    return model


def _in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` in as many partitions as their bytes fill blocks (at least one
    for every core): a small partition would bring as many distinct n-grams as a
    full block."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES)))


def _blocks(batch: pa.RecordBatch):
    """For each block of a batch: its name, rows and texts. The name comes from
    the texts, so a task that runs again names it the same; blocks of the same
    texts share one name, and the same n-grams."""
    data, offsets = A.flat(batch.column("text"))
    for i, j in A.slices(offsets, BLOCK_BYTES):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        tag = hashlib.blake2b(part.tobytes() + at.tobytes(), digest_size=8).digest()
        yield int.from_bytes(tag, "little", signed=True), i, j, part, at


def block_grams(docs: DataFrame) -> DataFrame:
    """_block, g: the distinct n-grams of each block."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, _, _, data, offsets in _blocks(batch):
                grams = [np.zeros(0, np.int64)]
                for i, j in A.slices(offsets):
                    grams.append(pd.unique(Stream.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).gram))
                g = np.unique(np.concatenate(grams))
                for a in range(0, len(g), 100_000):
                    yield pa.record_batch([pa.array(np.full(len(g[a : a + 100_000]), name)), pa.array(g[a : a + 100_000])], ["_block", "g"])

    return docs.mapInArrow(run, "_block long, g long")


def _features(docs: DataFrame, model: Model, keep: list[str], save) -> DataFrame:
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kinds = f"{kinds}, " if keep else ""
    weights = model.weights
    docs = _in_blocks(docs.select(*keep, "text"))  # both passes read the same columns, so their batches are the same

    def named(batches):
        """A block's rows in a few compressed parcels, which shuffle in less space than texts."""
        for batch in batches:
            for name, i, j, _, offsets in _blocks(batch):
                for a, b in A.slices(offsets, PARCEL_BYTES):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                        writer.write_batch(batch.slice(i + a, b - a))
                    yield pa.record_batch([pa.array([name]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["_block", "_rows"])

    def judge(left, right):
        own, found = Ratios.of(right), []
        for parcel in left.column("_rows"):
            rows = pa.ipc.open_stream(parcel.as_buffer()).read_all().combine_chunks()
            data, offsets = A.flat(rows.column("text"))
            parts = [own.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in A.slices(offsets)]
            f = np.concatenate([np.zeros((0, len(FEATURES))), *parts])
            found.append(pa.table([*(rows.column(c) for c in keep), *(pa.array(f[:, k].copy()) for k in range(len(FEATURES))), pa.array(scores(f, weights))], [*keep, *FEATURES, "score"]))
        return pa.concat_tables(found)

    grams = save(block_grams(docs))
    ratios = save(model.gram_ratios(save(grams.select("g").distinct())))
    own = grams.join(ratios, "g").select("_block", "g", "ratio")
    blocks = docs.mapInArrow(named, "_block long, _rows binary")
    out = blocks.groupBy("_block").cogroup(own.groupBy("_block")).applyInArrow(judge, kinds + ", ".join(f"{c} double" for c in [*FEATURES, "score"]))
    return settled(out)


def learning_rows(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows to count, rows to calibrate on): labelled and not held out. A fifth
    of them, but about ``calibration_rows`` at most, calibrate: those whose
    doc_id has a small hash, so drawing them takes no order."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = settled(known.where(~held_out(F.col("doc_id"))))
    n, steps = known.count(), 1_000_003
    share = min(0.2, calibration_rows / max(1, n))
    calibrating: Column = F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < F.lit(int(share * steps))
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sent = F.broadcast(known) if n <= BROADCAST_LABELS else known
    rows = texts.join(sent, "doc_id")
    return rows.where(~calibrating), rows.where(calibrating)


def score_toxicity(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, from_files: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where score >= 0.5); text is
    left out.

    Learned from ``labels`` (doc_id, toxic) of the rows that ``held_out`` does
    not hold out; a doc_id labelled twice counts as toxic if one label says so,
    null and other labels count for nothing. All of them are counted but those
    that calibrate (``calibration_rows`` at most). Null and empty texts have
    features of 0 and get the score these give. Without labels of both classes
    the weights keep their defaults. Repeated rows and ids give repeated results;
    columns of ``docs`` named score or predicted are replaced, all others stay;
    an empty table gives an empty result.

    Texts are read twice and have to come in the same order both times.
    ``from_files`` says that ``docs`` is read straight from files, with nothing
    but column choices and filters behind; any others are stored for the run.
    """
    own = ["score", "predicted"]
    rest = [c for c in docs.columns if c not in [*own, "text"]]
    with scratch(docs.sparkSession) as save:
        docs = docs if from_files else save(docs)
        counted, calibration = learning_rows(docs.select("doc_id", "text"), labels, calibration_rows)
        model = fit(counted, calibration, save)
        shown, names, back = veiled(docs.select(*rest, "text"), rest)
        out = _features(shown, model, names, save)
    return out.select(*back, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
