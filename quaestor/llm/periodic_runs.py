"""Runs of periodically repeated words, by block convolution.

A run is a stretch of words that repeats with a smallest period q, at least three times and over at
least 24 words, as far as it goes on to either side. At the scale of block length B, a power of two,
texts are cut into aligned blocks. A run whose period is in [B, 2 B), or below 16 at the first scale
of B = 8, is so long that a whole block lies in it and returns q words later. So each block is
compared with the windows that follow it at all distances of its scale at once: words are numbers
below V, and the sum of squared differences, by an exact number-theoretic transform, is zero where
the block returns. B (V - 1)^2 stays below the modulus, so the sums are true integers. Different
words may share a number, so every hit is compared word by word; equal words never miss.

Hits of neighbouring blocks at one distance make one segment, which is extended to both sides. A
block that holds a word without another one closer than 2 B can't return there and isn't
convolved. Inside a known run of a period up to B, a block returns at multiples of that period only,
which have the same extent: such blocks and hits are left out, and of equal extents the smallest
period is kept.

Texts are independent of each other, so a table is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quaestor.llm.common import map_arrow, text_of
from quaestor.llm.partenum import in_parts

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
FIRST_BLOCK = 8
#: Longer blocks aren't needed; windows of larger scales are compared one after the other.
LARGEST_BLOCK = 1 << 14
#: Numbers in one transform, which bounds its memory.
TRANSFORM = 1 << 19

#: A prime of the form k * 2^23 + 1, and a generator of its units: fixed values.
PRIME, GENERATOR = 998_244_353, 3
SPREAD = np.uint64(0x9E3779B97F4A7C15)

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


@cache
def roots(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a primitive n-th root of unity and of its inverse, half of each."""
    found = []
    for root in (pow(GENERATOR, (PRIME - 1) // n, PRIME), pow(GENERATOR, (PRIME - 1) // n * (n - 1), PRIME)):
        powers = np.ones(max(n // 2, 1), "u8")
        have = 1
        while have < len(powers):
            step = np.uint64(pow(root, have, PRIME))
            powers[have : 2 * have] = powers[:have] * step % np.uint64(PRIME)
            have *= 2
        found.append(powers)
    return found[0], found[1]


def transformed(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row, in bit-reversed order."""
    m, n = rows.shape
    p, x, size = np.uint64(PRIME), rows, n
    while size > 1:
        half = size // 2
        parts = x.reshape(m, n // size, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1]
        x = np.stack([(low + high) % p, (low + p - high) % p * roots(n)[0][:: n // size] % p], axis=2).reshape(m, n)
        size = half
    return x


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of `transformed`, back in natural order."""
    m, n = rows.shape
    p, x, size = np.uint64(PRIME), rows, 2
    while size <= n:
        half = size // 2
        parts = x.reshape(m, n // size, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * roots(n)[1][:: n // size] % p
        x = np.stack([(low + high) % p, (low + p - high) % p], axis=2).reshape(m, n)
        size *= 2
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def returns(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each block equals its window, which is twice as long, at offsets 0 to B - 1.

    Products of words at a distance are a cyclic correlation; offsets below B don't wrap.
    """
    m, b = blocks.shape
    p = np.uint64(PRIME)
    turned = np.zeros((m, 2 * b), "u8")
    turned[:, 0] = blocks[:, 0]
    turned[:, 2 * b - 1 : b : -1] = blocks[:, 1:]
    both = restored(transformed(turned) * transformed(windows) % p)[:, :b]
    sums = np.zeros((m, 2 * b + 1), "u8")
    np.cumsum(windows * windows, axis=1, out=sums[:, 1:])
    own = (blocks * blocks).sum(1, dtype="u8")[:, None]
    return (own + sums[:, b : 2 * b] - sums[:, :b]) % p == 2 * both % p


def extended(codes: np.ndarray, place: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words from `place` on, forward or backward, equal those `distance` further on.

    Chunks double while they are equal throughout.
    """
    reach = np.zeros(len(place), "i8")
    active, chunk = np.arange(len(place)), 16
    while len(active):
        still = []
        rows = max(1, TRANSFORM // chunk)
        for lo in range(0, len(active), rows):
            some = active[lo : lo + rows]
            at = place[some, None] + step * (reach[some, None] + np.arange(chunk))
            inside = (at >= 0) & (at + distance[some, None] < len(codes))
            at = np.where(inside, at, 0)
            far = np.where(inside, at + distance[some, None], 0)
            differ = ~inside | (codes[at] != codes[far])
            first = np.where(differ.any(1), differ.argmax(1), chunk)
            reach[some] += first
            still.append(some[first == chunk])
        active = np.concatenate(still)
        chunk = min(2 * chunk, TRANSFORM)
    return reach


def run_table(codes: np.ndarray) -> np.ndarray:
    """start, length, period of every run in a sequence of numbers, by start and period."""
    n = len(codes)
    found = np.empty((0, 3), "i8")
    if n < LEAST_LENGTH:
        return found
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, 1 << 62, "i8")  # to the next equal word
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    mixed = (codes.astype("u8") + np.uint64(1)) * SPREAD >> np.uint64(32)
    scale = FIRST_BLOCK
    while scale * LEAST_EXPONENT <= n or scale == FIRST_BLOCK:
        b = min(scale, LARGEST_BLOCK)
        starts = np.arange(n // b) * b
        returning = gap[: len(starts) * b].reshape(-1, b).max(1, initial=0) < 2 * scale
        starts = starts[returning]
        short = found[found[:, 2] <= b]
        starts = starts[~_inside(short, starts, starts + 2 * scale + b)]
        if len(starts):
            spread = min(1 << 16, int(((PRIME - 1) // b) ** 0.5))
            numbers = np.concatenate([mixed * np.uint64(spread) >> np.uint64(32), np.zeros(3 * scale, "u8")])
            first = 0 if scale == FIRST_BLOCK else scale
            hits = []
            rows = max(1, TRANSFORM // (2 * b))
            for lo in range(0, len(starts), rows):
                some = starts[lo : lo + rows]
                blocks = numbers[some[:, None] + np.arange(b)]
                for offset in range(first, 2 * scale, b):
                    windows = numbers[np.minimum(some[:, None] + offset + np.arange(2 * b), len(numbers) - 1)]
                    row, lag = np.nonzero(returns(blocks, windows))
                    hits.append(np.stack([lag + offset, some[row]], axis=1))
            hit = np.concatenate(hits)
            hit = hit[~_inside(short, hit[:, 1], hit.sum(1) + b)]
            found = _kept(np.concatenate([found, _runs_at(codes, hit, b)]))
        scale *= 2
    return found


def _inside(runs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one of the runs, sorted by start, holds all of [low, high)."""
    if not len(runs):
        return np.zeros(len(low), bool)
    reach = np.maximum.accumulate(runs[:, 0] + runs[:, 1])
    before = np.searchsorted(runs[:, 0], low, side="right") - 1
    return (before >= 0) & (reach[before] >= high)


def _runs_at(codes: np.ndarray, hits: np.ndarray, b: int) -> np.ndarray:
    """Runs about the hits (distance, block start) that hold word by word."""
    n = len(codes)
    hits = hits[(hits[:, 0] > 0) & (hits[:, 0] + hits[:, 1] + b <= n)]
    step = max(1, TRANSFORM // b)
    true = [
        (codes[some[:, 1:] + np.arange(b)] == codes[some.sum(1)[:, None] + np.arange(b)]).all(1)
        for some in (hits[lo : lo + step] for lo in range(0, len(hits), step))
    ]
    hits = hits[np.concatenate(true)] if true else hits
    if not len(hits):
        return np.empty((0, 3), "i8")
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    new = np.ones(len(hits), bool)
    new[1:] = (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + b)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hits)) - 1
    distance, low, high = hits[heads, 0], hits[heads, 1], hits[tails, 1] + b
    low = low - extended(codes, low - 1, distance, -1)
    high = high + extended(codes, high, distance, 1)
    length = high - low + distance
    enough = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * distance)
    return np.stack([low, length, distance], axis=1)[enough]


def _kept(runs: np.ndarray) -> np.ndarray:
    """One run of each extent, that of the smallest period, by start and period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: none does that a run holds after its first period."""
    change = np.zeros(n + 1, "i8")
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _scanned(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in RUN.names]))
    for part, found in in_parts(batches):
        texts = [t.encode().split() for t in found]
        counts = np.array([len(ws) for ws in texts], "i8")
        # A number of its own after each text: no run goes over it.
        numbered: dict[bytes, int] = {}
        number = numbered.setdefault
        flat = [[*(number(w, len(numbered)) for w in ws), -1] for ws in texts]
        codes = np.fromiter(chain.from_iterable(flat), "i8", int(counts.sum()) + len(texts))
        ends = np.flatnonzero(codes < 0)
        codes[ends] = len(numbered) + np.arange(len(ends))
        runs = run_table(codes)
        begins = ends - counts
        owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
        stays = kept_words(len(codes), runs)
        collapsed = [
            b" ".join(ws if stays[lo:hi].all() else [w for w, stay in zip(ws, stays[lo:hi], strict=True) if stay])
            for ws, lo, hi in zip(texts, begins, ends, strict=True)
        ]
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype("i4")
        rows = pa.StructArray.from_arrays(
            [pa.array(x) for x in (runs[:, 0] - begins[owner], runs[:, 1], runs[:, 2])], fields=list(kind.value_type)
        )
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in kept), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), rows, type=kind),
             pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=[*kept, "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The frame's columns but `text`, and `n_words`, `runs` and `collapsed`, one row per row.

    `runs` are (start, length, period) in words, by start and period; runs may overlap. `collapsed` has
    the words that no run holds after its first period, joined by one space. Words stand between
    ASCII white space and are compared as they are. Null and empty texts have no words, no run and
    an empty `collapsed`. Rows don't depend on each other, so equal ones give equal rows; a very
    long text is one row of one task, in memory that is a multiple of its length. Columns of the
    frame named like the three new ones are replaced by them.
    """
    new = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in ("text", *new)]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept])
    schema = schema.add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")
    texts = docs.select(*(F.col(f"`{c}`") for c in kept), text_of().alias("text"))
    return map_arrow(texts, lambda batches: _scanned(batches, kept), schema)
