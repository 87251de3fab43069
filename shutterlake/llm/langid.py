"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of UTF-8 bytes forwards and backwards, labels every
byte position with language probabilities, and a text's probabilities are the
mean over all its positions. It is trained in numpy by backpropagation through
time on a bounded sample of labelled texts; labelling is a map over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .shared import veiled

UNDETERMINED = "und"
HIDDEN = 8
SEGMENT = 64
#: Bound of the training sample: texts per language, and segments of each text.
SAMPLE_TEXTS = 500
SAMPLE_SEGMENTS = 4
STEPS = 300
_LANES = 2048


def _sigmoid(x):
    return np.float32(1) / (np.float32(1) + np.exp(-x))


@dataclass
class Network:
    """``wx``: 2 x 3H x 256, ``u``: 2 x 3H x H, ``b``: 2 x 3H x 1 (gates: update,
    reset, candidate; directions: forwards, backwards); ``wo``: K x 2H, ``bo``: K x 1."""

    labels: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 17) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        return cls(
            labels,
            {
                "wx": draw(2, 3 * hidden, 256, scale=0.3),
                "u": draw(2, 3 * hidden, hidden, scale=hidden**-0.5),
                "b": np.zeros((2, 3 * hidden, 1), np.float32),
                "wo": draw(len(labels), 2 * hidden, scale=0.1),
                "bo": np.zeros((len(labels), 1), np.float32),
            },
        )

    def states(self, data: np.ndarray, trace: bool = False):
        """Hidden states 2 x T x H x N of segments ``data`` (T x N bytes)."""
        wx, u, b = (self.p[k] for k in ("wx", "u", "b"))
        t_n, n = data.shape
        h_n = u.shape[2]
        out = np.empty((2, t_n, h_n, n), np.float32)
        kept = [[], []]
        for way in (0, 1):
            table = wx[way] + b[way]
            h = np.zeros((h_n, n), np.float32)
            for t in range(t_n) if way == 0 else range(t_n - 1, -1, -1):
                x = np.take(table, data[t], axis=1)
                g = u[way] @ h
                gates = _sigmoid(x[: 2 * h_n] + g[: 2 * h_n])
                z, r = gates[:h_n], gates[h_n:]
                c = np.tanh(x[2 * h_n :] + r * g[2 * h_n :])
                if trace:
                    kept[way].append((t, h, z, r, c, g[2 * h_n :]))
                h = c + z * (h - c)
                out[way, t] = h
        return (out, kept) if trace else out

    def position_probabilities(self, states: np.ndarray) -> np.ndarray:
        """K x T x N."""
        h_n = states.shape[2]
        score = np.tensordot(self.p["wo"][:, :h_n], states[0], (1, 1)) + np.tensordot(self.p["wo"][:, h_n:], states[1], (1, 1))
        score += self.p["bo"][:, :, None]
        score -= score.max(axis=0)
        np.exp(score, out=score)
        score /= score.sum(axis=0)
        return score

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions, and its gradient."""
        states, kept = self.states(data, trace=True)
        prob = self.position_probabilities(states)
        t_n, n = data.shape
        h_n = states.shape[2]
        lane = np.arange(n)
        loss = -float(np.log(prob[target, :, lane] + 1e-9).mean())
        prob[target, :, lane] -= 1
        prob /= t_n * n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bo"][:, 0] = prob.sum(axis=(1, 2))
        for way in (0, 1):
            g["wo"][:, way * h_n : (way + 1) * h_n] = np.tensordot(prob, states[way], ((1, 2), (0, 2)))
            back = self.p["wo"][:, way * h_n : (way + 1) * h_n].T
            u = self.p["u"][way]
            dh = np.zeros((h_n, n), np.float32)
            for t, h, z, r, c, gc in reversed(kept[way]):
                dh = dh + back @ prob[:, t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc])
                dg = np.concatenate([dz, dr, dc * r])
                g["u"][way] += dg @ h.T
                for k in range(3 * h_n):
                    g["wx"][way, k] += np.bincount(data[t], dx[k], 256)
                dh = dh * z + u.T @ dg
            g["b"][way, :, 0] = g["wx"][way].sum(axis=1)
        return loss, g

    def train(self, segments: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 3) -> None:
        """Adam over random batches of ``segments`` (N x T bytes)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(segments), min(batch, 4 * len(segments)))
            _, g = self.gradients(np.ascontiguousarray(segments[pick].T), target[pick])
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            for k in self.p:
                d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                pace = rate * (1 - 0.9 * step / steps)
                self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def text_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean position probabilities of each row (rows x K); zeros for empty ones."""
        size = np.diff(offsets)
        lanes = -(-size // SEGMENT)
        row = np.repeat(np.arange(len(size)), lanes)
        start = offsets[:-1][row] + A.ramp(lanes) * SEGMENT
        stop = np.minimum(start + SEGMENT, offsets[1:][row])
        sums = np.zeros((len(row), len(self.labels)))
        for a in range(0, len(row), _LANES):
            at = start[a : a + _LANES, None] + np.arange(SEGMENT)
            real = at < stop[a : a + _LANES, None]
            bytes_ = np.where(real, data[np.minimum(at, len(data) - 1)], np.uint8(32))
            prob = self.position_probabilities(self.states(np.ascontiguousarray(bytes_.T)))
            sums[a : a + _LANES] = (prob * real.T[None]).sum(axis=1).T
        out = np.zeros((len(size), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(row, sums[:, k], len(size))
        return out / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample_segments(docs: DataFrame, per_label: int = SAMPLE_TEXTS, segments: int = SAMPLE_SEGMENTS) -> tuple[list[str], list[str]]:
    """(segments, labels) of about ``per_label`` texts of each language, drawn by
    a hash of doc_id from the rows that are not held out. The sample's size does
    not grow with the table."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * per_label / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    cuts = F.array(*[F.expr(f"substring(text, 1 + pmod(xxhash64(doc_id, {k}), greatest(1, length(text) - {SEGMENT} + 1)), {SEGMENT})") for k in range(segments)])
    rows = known.where(drawn).select("lang", F.explode(cuts).alias("part")).distinct().orderBy(F.xxhash64("part"), "part", "lang").limit(2 * per_label * segments * len(counts)).collect()
    return [r["part"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, per_label: int = SAMPLE_TEXTS, steps: int = STEPS) -> Network:
    """A network for the languages of ``docs`` (doc_id, text, lang)."""
    parts, langs = sample_segments(docs, per_label)
    labels = sorted(set(langs))
    network = Network.fresh(labels)
    if len(labels) > 1:
        raw = [p.encode()[:SEGMENT].ljust(SEGMENT) for p in parts]
        target = np.array([labels.index(x) for x in langs])
        # languages count alike, however common they are
        weight = 1 / np.bincount(target)[target]
        pick = np.random.default_rng(5).choice(len(raw), 4 * len(raw), p=weight / weight.sum())
        network.train(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SEGMENT)[pick], target[pick], steps)
    return network


def label(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with lang_pred and score (the pooled probability of lang_pred).

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned. Repeated rows and ties give repeated results (a tie: the first
    language in order). Like-named columns are replaced; an empty table gives
    an empty result.
    """
    own = ["lang_pred", "score"]
    kept = [c for c in docs.columns if c not in own]
    docs, rest, back = veiled(docs.select(*(F.col(f"`{c}`") for c in kept)), kept)
    text = rest[kept.index("text")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        names = np.array([*network.labels, UNDETERMINED], object)
        for batch in batches:
            data, offsets = A.flat(batch.column(text))
            letter = batch.column("_letter")
            for i, j in A.slices(offsets):
                some = np.array(letter.slice(i, j - i).to_pylist(), bool)
                if network.labels:
                    prob = network.text_probabilities(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best = np.where(some, prob.argmax(axis=1), len(names) - 1)
                    score = np.where(some, np.clip(prob.max(axis=1), 0, 1), 0.0)
                else:
                    best, score = np.full(j - i, len(names) - 1), np.zeros(j - i)
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in rest), pa.array(names[best], pa.string()), pa.array(score)], [*rest, *own])

    return docs.select(*rest, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter")).mapInArrow(run, f"{kinds}, lang_pred string, score double").select(*back, *own)
