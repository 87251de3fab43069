"""Removal of passages that repeat anywhere in the corpus, by recompression.

A text is a string of words. Rounds of recompression shorten it: a round first
replaces short runs of one symbol, then adjacent pairs whose left and right
symbol fall into the two halves of the alphabet of that round. A new symbol's
name is a hash of what it stands for, so equal strings get equal names in every
task, without a table of names. How a piece is compressed depends on its
neighbours only near its ends: after two rounds whose symbols span at most 2
and 4 words, equal passages have equal symbols except within ``MARGIN`` words
of either end. (Round one: a run of two words, one word that pairs outwards;
round two: a run of four words, a symbol of three words that pairs outwards.)

Each window of ``WINDOW`` words is led by the symbol of least hash that lies
fully inside its margins, so every window that it leads also holds the
``MARGIN`` words before and after it. Equal windows have equal leaders at equal
places with equal surroundings, so
  * a window whose leader, so surrounded, stands nowhere else is unique;
  * all windows that one leader leads form one stretch; stretches that equal
    another one (by two 64-bit hashes) settle all their windows at once, which
    covers the inside of every long repeat;
  * only the remaining stretches, at the ends of repeats, are compared window
    by window with those that share their leader and its surroundings.

Counting "elsewhere" goes by the least and the greatest place of a name or
hash, an aggregation that collapses in each task, and its result is joined
back; a passage that a third of all texts share is one row of the first and an
evenly dealt (or split) side of the second. Texts with the same word sequence
count as one place here: that they repeat each other is found by their sequence
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .ngram_join import sequence_hashes
from .shared import scratch, settled, veiled

WINDOW = 35
MARGIN = 10
_ROUNDS = (2, 4)


def recompress(names: np.ndarray, row: np.ndarray, rounds=_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and spans (in words) of the symbols after all rounds. ``rounds``:
    the longest span that each round may make."""
    span = np.ones(len(names), np.int64)
    for k, longest in enumerate(rounds):
        tag = A.odd_factors(6, 7000 + k)
        if not len(names):
            break
        # runs
        new = np.append(True, (names[1:] != names[:-1]) | (row[1:] != row[:-1]))
        head = np.flatnonzero(new)
        times = np.diff(np.append(head, len(names)))
        squeeze = (times > 1) & (times * span[head] <= longest)
        keep = np.ones(len(names), bool)
        inside = np.repeat(squeeze, times)
        keep[inside] = False
        keep[head[squeeze]] = True
        names = names.copy()
        span = span.copy()
        names[head[squeeze]] = A.mix(names[head[squeeze]] * tag[0] + times[squeeze].astype(A.U64) * tag[1])
        span[head[squeeze]] *= times[squeeze]
        names, span, row = names[keep], span[keep], row[keep]
        # pairs
        left = (A.mix(names ^ tag[2]) & A.U64(1)) == 0
        pair = np.flatnonzero(left[:-1] & ~left[1:] & (row[1:] == row[:-1]) & (span[:-1] + span[1:] <= longest))
        names[pair] = A.mix(names[pair] * tag[3] + A.mix(names[pair + 1] ^ tag[5]) * tag[4])
        span[pair] += span[pair + 1]
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, span, row = names[keep], span[keep], row[keep]
    return names, span


class Rolling:
    """Two 64-bit hashes of any stretch of words."""

    def __init__(self, hashed: np.ndarray):
        self.parts = []
        for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):  # both 5 modulo 8
            n = len(hashed)
            power = np.full(n + 1, base, A.U64)
            power[0] = 1
            inverse = np.full(n + 1, pow(base, -1, 2**64), A.U64)
            inverse[0] = 1
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
            sums = np.concatenate([np.zeros(1, A.U64), np.cumsum(hashed * power[:n], dtype=A.U64)])
            self.parts.append((sums, inverse))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        size = (end - start).astype(A.U64) * A.U64(0xA0761D6478BD642F)
        return [A.mix((sums[end] - sums[start]) * inverse[start] + size) for sums, inverse in self.parts]


def stretches(hashed: np.ndarray, first: np.ndarray, window: int = WINDOW, margin: int = MARGIN):
    """Leader's key, first window and number of windows of every stretch, and
    its row. Places are indices into ``hashed``. The key names the leader with
    the ``margin`` words on either side, which every window it leads holds."""
    row = A.rows_of(first)
    names, span = recompress(hashed, row)
    begin = np.cumsum(span) - span
    ends = begin + span
    p = np.flatnonzero(first[1:][row] - np.arange(len(hashed)) >= window)
    if not len(p):
        none = np.zeros(0, np.int64)
        return np.zeros(0, A.U64), none, none, none
    symbol = np.repeat(np.arange(len(names)), span)
    lo = symbol[p + margin]
    lo += begin[lo] < p + margin
    hi = symbol[p + window - margin - 1]
    hi += ends[hi] <= p + window - margin
    order = A.mix(names ^ A.U64(0x5851F42D4C957F2D))
    # least by doubling: best[k][i] is the leftmost least of 2**k symbols from i
    best = [np.arange(len(names))]
    while 2 ** len(best) <= window:
        step = 2 ** (len(best) - 1)
        a = best[-1]
        b = a[np.minimum(np.arange(len(a)) + step, len(a) - 1)]
        best.append(np.where(order[b] < order[a], b, a))
    size = hi - lo
    if size.min() < 1:
        raise AssertionError("a window without a symbol inside its margins")
    level = np.frexp(size)[1] - 1
    leader = np.empty(len(p), np.int64)
    for k in range(len(best)):
        at = np.flatnonzero(level == k)
        a, b = best[k][lo[at]], best[k][hi[at] - 2**k]
        leader[at] = np.where(order[b] < order[a], b, a)
    head = np.flatnonzero(np.append(True, leader[1:] != leader[:-1]))
    lead = leader[head]
    key = Rolling(hashed).of(begin[lead] - margin, ends[lead] + margin)[0]
    return key, p[head], np.diff(np.append(head, len(p))), row[p[head]]


def find_stretches(docs: DataFrame, window: int) -> DataFrame:
    """Per row of ``docs`` one with name null and n its number of words, and one
    for each stretch: name, p (first window), n (windows), u1, u2 (hashes of its
    words). Stretches are known by their text (s1, s2); their _id and _rk are null."""

    def run(batches):
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            for i, j in A.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = A.words(part, at)
                hashed = A.word_hashes(part, starts, ends)
                s1, s2 = (A.signed(s) for s in sequence_hashes(hashed, first))
                name, p, n, row = stretches(hashed, first, window)
                u1, u2 = (A.signed(u) for u in Rolling(hashed).of(p, p + n + window - 1))
                whole = np.arange(j - i)
                row, lone = np.concatenate([whole, row]), len(whole)
                gap = np.zeros(lone, np.int64)
                order = np.argsort(row, kind="stable")
                columns = [
                    np.concatenate([gap, p - first[row[lone:]]]).astype(np.int32),
                    np.concatenate([np.diff(first), n]).astype(np.int32),
                    np.concatenate([gap, u1]),
                    np.concatenate([gap, u2]),
                ]
                of_text = (np.arange(len(row)) < lone)[order]
                names = pa.array(np.concatenate([gap, A.signed(name)])[order], mask=of_text)
                own = pa.array(row[order], mask=~of_text)
                keys = [batch.column(c).slice(i, j - i).take(own) for c in ("_id", "_rk")]
                yield pa.record_batch(
                    [*keys, pa.array(s1[row[order]]), pa.array(s2[row[order]]), names, *(pa.array(c[order]) for c in columns)],
                    ["_id", "_rk", "s1", "s2", "name", "p", "n", "u1", "u2"],
                )

    return docs.mapInArrow(run, "_id long, _rk long, s1 long, s2 long, name long, p int, n int, u1 long, u2 long")


def window_hashes(docs: DataFrame, window: int) -> DataFrame:
    """A row per window of the stretches in ``spans`` (array of p, n): its words'
    hashes h1, h2 and its place s1, s2, p."""

    def run(batches):
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            spans = batch.column("spans")
            for i, j in A.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = A.words(part, at)
                rolling = Rolling(A.word_hashes(part, starts, ends))
                some = spans.slice(i, j - i)
                row = np.repeat(np.arange(j - i), np.array(pa.compute.list_value_length(some)))
                flat = some.flatten()
                p, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                row, p = np.repeat(row, n), np.repeat(p, n) + A.ramp(n)
                for a in range(0, len(p), 100_000):
                    r, q = row[a : a + 100_000], p[a : a + 100_000]
                    h1, h2 = rolling.of(first[r] + q, first[r] + q + window)
                    keys = [batch.column(c).slice(i, j - i).take(pa.array(r)) for c in ("s1", "s2")]
                    yield pa.record_batch([*keys, pa.array(q.astype(np.int32)), pa.array(A.signed(h1)), pa.array(A.signed(h2))], ["s1", "s2", "p", "h1", "h2"])

    return docs.mapInArrow(run, "s1 long, s2 long, p int, h1 long, h2 long")


def cut(docs: DataFrame, kinds: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, n_removed and kept_text: the words that no
    interval of ``spans`` covers, joined by one blank."""

    def run(batches):
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            spans = batch.column("spans")
            for i, j in A.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = A.words(part, at)
                some = spans.slice(i, j - i)
                row = np.repeat(np.arange(j - i), np.array(pa.compute.list_value_length(pa.compute.coalesce(some, pa.scalar([], some.type)))))
                flat = some.flatten()
                p, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[row] + p, 1)
                np.add.at(edge, first[row] + p + n, -1)
                kept = np.cumsum(edge[:-1]) == 0
                rows = A.rows_of(first)
                left = np.bincount(rows[kept], minlength=j - i)
                size = (ends - starts)[kept] + 1
                body = np.append(part, np.uint8(32))
                source = np.repeat(starts[kept], size) + A.ramp(size)
                stop = np.cumsum(size) - 1
                text = body[source] if len(source) else body[:0]
                text[stop] = 32
                at_word = np.concatenate([[0], np.cumsum(left)])
                to = np.concatenate([[0], np.cumsum(size)])[at_word]
                # the blank behind a text's last word goes
                last = stop[at_word[1:][left > 0] - 1]
                text = np.delete(text, last)
                to = to - np.concatenate([[0], np.cumsum(left > 0)])
                out = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.string())
                total = np.diff(first)
                own = [batch.column(c).slice(i, j - i) for c in keep]
                yield pa.record_batch([*own, pa.array(total), pa.array(total - left), out], [*keep, "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(run, f"{kinds}, n_words long, n_removed long, kept_text string")


def _elsewhere(rows: DataFrame, by: list[str]) -> DataFrame:
    """The keys ``by`` that stand at two places or more."""
    place = F.xxhash64("s1", "s2", "p")
    return rows.groupBy(*by).agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a != _b").select(*by)


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(doc_id, text).alias("_rk")]


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _rk and spans: for each row of ``docs`` with words to remove, the
    intervals (p, n) of words."""
    texts = docs.select(*_keys(F.col("doc_id"), F.col("text")), "text")
    with scratch(docs.sparkSession) as save:
        found = save(find_stretches(texts, window))
        whole = found.where(f"name IS NULL AND n >= {window}").select("_id", "_rk", "s1", "s2", "n")
        # texts that repeat go as a whole; their stretches only tell about others
        by_text = save(whole.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("_id", "_rk")).alias("one")))
        of_copies = whole.join(by_text.where("k > 1").select("s1", "s2"), ["s1", "s2"], "left_semi").select("_id", "_rk", F.array(F.struct(F.lit(0).alias("p"), "n")).alias("spans"))
        led = found.where("name IS NOT NULL").drop("_id", "_rk")
        # Keys are stored before they are joined: then the rows of a key that many texts
        # share are a side of the join by themselves, which adaptive execution splits.
        shared = save(led.join(save(_elsewhere(led, ["name"])), "name", "left_semi"))
        equal = save(_elsewhere(shared, ["u1", "u2"])).withColumn("whole", F.lit(True))
        judged = save(shared.join(equal, ["u1", "u2"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))))
        open_ones = judged.where("NOT whole")
        # equal stretches have equal names: they collapse before the join by name
        alike = judged.where("whole").groupBy("name", "u1", "u2").agg(F.min(F.struct("s1", "s2", "p", "n")).alias("x"))
        one_each = alike.join(save(open_ones.select("name").distinct()), "name", "left_semi").select("x.*")
        look = open_ones.select("s1", "s2", "p", "n").unionByName(one_each)
        look = look.groupBy("s1", "s2").agg(F.collect_set(F.struct("p", "n")).alias("spans")).join(by_text, ["s1", "s2"]).select("one.*", "s1", "s2", "spans")
        windows = save(window_hashes(texts.join(look.hint("shuffle_hash"), ["_id", "_rk"]), window))
        twice = windows.join(save(_elsewhere(windows, ["h1", "h2"])), ["h1", "h2"], "left_semi").select("s1", "s2", "p", F.lit(window).alias("n"))
        settled_ones = judged.where("whole").select("s1", "s2", "p", (F.col("n") + F.lit(window - 1)).alias("n"))
        every = settled_ones.unionByName(twice).groupBy("s1", "s2").agg(F.collect_set(F.struct(F.col("p").cast("int").alias("p"), F.col("n").cast("int").alias("n"))).alias("spans"))
        of_others = every.join(by_text.where("k = 1"), ["s1", "s2"]).select("one.*", "spans")
        return settled(of_copies.distinct().unionByName(of_others))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (words that stay, joined
    by one blank); text is left out.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of
    ``window`` consecutive words of its text that covers it also starts anywhere
    else, in the same text or another, all judged on the input. Null, empty and
    short texts lose nothing; repeated rows repeat each other. doc_id may be
    null or repeat. Columns named as the three are replaced. An empty table gives
    an empty result.
    """
    if window < WINDOW:
        raise ValueError(f"the margins need windows of at least {WINDOW} words")
    own = ["n_words", "n_removed", "kept_text"]
    rest = [c for c in docs.columns if c not in [*own, "text"]]
    spans = repeated_spans(docs.select("doc_id", "text"), window)
    shown, names, back = veiled(docs.select(*(F.col(f"`{c}`") for c in rest), "text"), rest)
    shown = shown.select("*", *_keys(F.col(names[rest.index("doc_id")]), F.col("text")))
    kinds = ", ".join(f"`{n}` {shown.schema[n].dataType.simpleString()}" for n in names)
    return cut(shown.join(spans.hint("shuffle_hash"), ["_id", "_rk"], "left").drop("_id", "_rk"), kinds, names).select(*back, *own)
