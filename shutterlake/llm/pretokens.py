"""Byte-level BPE pre-tokens of many texts at once.

``split`` finds the boundaries that ``public_tokenizers.PATTERN`` defines, on
arrays of code points; ``Encoder`` turns each distinct pre-token into ids once
per worker and looks the rest up.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from . import arrays as A

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Unicode's White_Space characters.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    out = np.full(0x110000, OTHER, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, with the rows' offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


def split(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pre-tokens (each ends where the next begins), and the index
    of each row's first one (n + 1 entries)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last white space before a word stands alone or, if a blank, joins the word.
    nxt = np.zeros(n, bool)
    nxt[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
    last = np.flatnonzero(nxt)
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll split off where the apostrophe starts a token.
    at = np.flatnonzero((points == 39) & start)
    at = at[(at + 1 < n)]
    at = at[~edge[at + 1] & (kind[at + 1] == LETTER)]
    if len(at):
        one = points[at + 1]
        two = np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], points[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        at, size = at[hit], np.where(short, 1, 2)[hit]
        start[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < n]
        start[rest] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


_PLACE = A._Factors(29)


def hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every pre-token."""
    if not len(starts):
        return np.zeros(0, A.U64)
    sizes = np.diff(np.append(starts, len(points)))
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    values = points.astype(A.U64) + A.U64(1)
    values *= _PLACE.upto(int(sizes.max()))[place]
    return A.mix(np.add.reduceat(values, starts) + sizes.astype(A.U64) * A.U64(0xD6E8FEB86659FD93))


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


class Encoder:
    """Ids of pre-tokens, each distinct one merged once for this worker."""

    LIMIT = 1_500_000

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self._clear()

    def _clear(self):
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, hashed: list[int], pieces: list[str]) -> None:
        encode = encoding(self.path, self.pattern).encode_ordinary
        new = [encode(x) for x in pieces]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        have, k = len(self.known), len(new)
        while have + k + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while self.used + sizes.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + sizes.sum()] = [i for x in new for i in x]
        self.ends[have + 1 : have + k + 1] = self.used + np.cumsum(sizes)
        self.used += int(sizes.sum())
        self.known.update(zip(hashed, range(have, have + k)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the rows' n + 1 offsets among them."""
        points, at = code_points(data, offsets)
        starts, first = split(points, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > self.LIMIT:
            self._clear()
        codes, distinct = pd.factorize(hashes(points, starts))
        distinct = distinct.tolist()
        missing = [k for k, h in enumerate(distinct) if h not in self.known]
        if missing:
            where = np.zeros(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            ends = np.append(starts, len(points))
            chars = points.astype("<u4")
            self._learn([distinct[k] for k in missing], [chars[ends[w] : ends[w + 1]].tobytes().decode("utf-32-le") for w in where[missing].tolist()])
        slot = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[codes]
        begin = self.ends[slot]
        sizes = self.ends[slot + 1] - begin
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[first]
