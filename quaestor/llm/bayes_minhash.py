"""MinHash near-duplicates with sequential Bayesian verification.

A text's set of word shingles is signed by minima of hash functions. BANDS bands of ROWS minima make
buckets: two sets at the threshold share none with probability (1 - 0.85^5)^25 = 4e-7. Pairs of a
bucket are then compared by CHECKED further minima, batch after batch. With m of n equal, a uniform
prior makes the similarity's posterior Beta(m + 1, n - m + 1); a pair whose probability to reach the
threshold falls below MISS is given up. What survives all batches is verified on the full sets.

Buckets don't yield all their pairs:

- An element that no other text in any bucket has lowers every similarity of its set, so a set with
  more than 15 % of such own elements links with nothing, and leaves. Then others have more of them.
- In two turns each bucket's members are compared with one pivot, first the one with the least share
  of own elements, which links if any does. A bucket that is one component by then is done.
- Only pairs across components are left, each made in the first bucket that it shares, and only if
  own elements and sizes allow the threshold. Large buckets are cut into blocks for that, so no task
  has one alone.

Texts are known by 128 bits of hash and numbered; equal texts are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaestor.llm.common import map_arrow, small, text_of, written
from quaestor.llm.components import components
from quaestor.llm.pairs import BATCH_BYTES, arrow_bytes, beside, busy_texts, own_counts
from quaestor.llm.partenum import in_parts, mix, shingle_sets

WIDTH, PERCENT = 5, 85
BANDS, ROWS = 25, 5
CHECKED, BATCH = 128, 16
#: Posterior probability of reaching the threshold below which a pair is given up.
MISS = 1e-6
#: How often own elements are counted, each time among the texts that stayed.
PEELS = 3
#: Members of a bucket's block.
BLOCK = 256

HASHES = "h1", "h2"


@cache
def multipliers() -> np.ndarray:
    """Odd factors: multiplying the evenly spread shingles by them reorders them anew each time."""
    return mix(np.arange(1, BANDS * ROWS + CHECKED + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over each set; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * a, starts) for a in multipliers()], axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key of each band, of its number and its minima."""
    rows = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    keys = np.tile(mix(np.arange(1, BANDS + 1, dtype="u8")), (len(rows), 1))
    for i in range(ROWS):
        keys = mix(keys + rows[:, :, i])
    return keys


def sketches(least: np.ndarray) -> np.ndarray:
    """16 bits of each minimum that is checked: more may seem equal, never fewer."""
    return (least[:, BANDS * ROWS :] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)).astype("u2")


@cache
def least_matches() -> tuple[int, ...]:
    """After each batch, the fewest matches with which a pair goes on.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m).
    """
    t, out = PERCENT / 100, []
    for n in range(BATCH, CHECKED + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches are still likely enough after all batches."""
    active, matches = np.arange(len(a)), np.zeros(len(a), "i8")
    for i, need in enumerate(least_matches()):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[active] += (a[active, part] == b[active, part]).sum(1)
        active = active[matches[active] >= need]
    keep = np.zeros(len(a), bool)
    keep[active] = True
    return keep


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h1, h2, n, bands, sketch; the last two are null in texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in in_parts(batches):
            sets = shingle_sets(found, width)
            sizes = np.array([len(x) for x in sets])
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if filled := np.flatnonzero(sizes).tolist():
                least = minima([sets[i] for i in filled])
                for i, keys, bits in zip(filled, band_keys(least).view("i8"), sketches(least), strict=True):
                    bands[i], sketch[i] = keys, bits.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(sizes, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "h1", "h2", "n", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        hashed(docs), run, f"doc_id {kind}, h1 long, h2 long, n long, bands array<long>, sketch binary"
    )


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and 128 bits that stand for the text."""
    text = text_of()
    return docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), "u2").reshape(-1, CHECKED)
            for c in ("sketch_a", "sketch_b")
        )
        yield batch.select(["a", "b"]).filter(pa.array(survive(a, b), pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)
        keep = [linked(*(np.frombuffer(x.as_buffer(), "u8") for x in pair)) for pair in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link: by batches of the sketches first, then by full sets."""
    pairs = written(pairs.distinct())
    busy = busy_texts(pairs)
    likely = written(map_arrow(beside(pairs, texts, "sketch", busy), _survivors, "a long, b long"))
    with arrow_bytes(pairs.sparkSession, BATCH_BYTES):
        return written(map_arrow(beside(likely, sets, "hashes", busy), _linked, "a long, b long"))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, found in in_parts(batches):
        sets = [x.tobytes() for x in shingle_sets(found, width)]
        yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sets, pa.binary())], names=["k", "hashes"])


def may_link(n_x: Column, u_x: Column, n_y: Column, u_y: Column) -> Column:
    """Own elements differ for sure, and so does what one set has more of the others."""
    differ = u_x + u_y + F.abs((n_x - u_x) - (n_y - u_y))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (n_x + n_y)


def starred(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot and its other members."""
    first = F.col("u") / F.col("n") if turn == 0 else F.xxhash64(F.lit(turn), "k")
    pivots = (
        buckets.groupBy("sig").agg(F.min(F.struct(first, "k", "n", "u")).alias("p"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1").select("sig", *[F.col(f"p.{c}").alias(f"{c}_p") for c in ("k", "n", "u")])
    )
    rows = buckets.join(pivots, "sig").filter("k <> k_p").filter(may_link(*(F.col(c) for c in ("n", "u", "n_p", "u_p"))))
    return rows.select(F.least("k", "k_p").alias("a"), F.greatest("k", "k_p").alias("b"))


def across(members: DataFrame, bands: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (sig, k, n, u, root) of different components that may link, each once.

    One of a pair's texts isn't in the bucket's main component.
    """
    sizes = members.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("sig").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("roots"),
    ).filter("roots > 1")
    placed = written(
        members.join(main.select("sig", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "sig")
        .join(bands, "k")
    )
    columns = ("k", "n", "u", "root", "bands")
    left = placed.filter("root <> main").select(
        "sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_x") for c in columns]
    )
    right = placed.select(
        "sig", F.pmod(F.xxhash64("k"), "blocks").cast("int").alias("block"), (F.col("root") == F.col("main")).alias("in_main"),
        *[F.col(c).alias(f"{c}_y") for c in columns],
    )
    may = (
        (F.col("root_x") != F.col("root_y"))
        & (F.col("in_main") | (F.col("k_x") < F.col("k_y")))
        & may_link(*(F.col(c) for c in ("n_x", "u_x", "n_y", "u_y")))
        & (F.get(F.array_intersect("bands_x", "bands_y"), F.lit(0)) == left["sig"])
    )
    found = left.join(right, (left["sig"] == right["sig"]) & (left["block"] == right["block"]) & may)
    return found.select(F.least("k_x", "k_y").alias("a"), F.greatest("k_x", "k_y").alias("b"))


def links(docs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b) of numbered texts that connect every two that link."""
    rows = texts.filter("n > 0").select("k", F.explode("bands").alias("sig"))
    shared = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("sig")
    buckets = written(rows.join(shared, "sig", "left_semi"))
    opened = written(texts.select("k", "n", *HASHES, F.col("least_id").alias("doc_id")).join(
        buckets.select("k").distinct(), "k", "left_semi"
    ))
    wanted = small(opened.select("k", *HASHES, F.col("doc_id").alias("least_id")))
    all_docs = hashed(docs)
    owner = [all_docs[h] == wanted[h] for h in HASHES] + [all_docs["doc_id"].eqNullSafe(wanted["least_id"])]
    own = all_docs.join(wanted, owner).select("k", "text")
    sets = written(map_arrow(own, lambda batches: _sets(batches, width), "k long, hashes binary").dropDuplicates(["k"]))
    alive = opened
    for _ in range(PEELS):
        facts = alive.select("k", "n").join(own_counts(sets.join(small(alive.select("k")), "k", "left_semi")), "k", "left")
        own = F.coalesce("u", F.lit(0)).alias("u")
        alive = written(facts.select("k", "n", own).filter(100 * (F.col("n") - F.col("u")) >= PERCENT * F.col("n")))
    crowd, found = written(buckets.join(small(alive), "k")), None
    for turn in range(2):
        new = verified(starred(crowd, turn), texts.select("k", "sketch"), sets)
        found = new if found is None else found.unionAll(new)
        groups = small(written(components(found).withColumnRenamed("node", "k")))
        members = crowd.join(groups, "k", "left").select("sig", "k", "n", "u", F.coalesce("root", "k").alias("root"))
        unlike = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        members = written(members.join(unlike.select("sig"), "sig", "left_semi"))
        crowd = members.drop("root")
    return found.unionAll(verified(across(members, texts.select("k", "bands")), texts.select("k", "sketch"), sets))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    component_id is the smallest doc_id that links reach, kept whether it is the row's own. Texts
    that are null, empty or without words have no shingles, are linked with nothing and stand for
    themselves. Texts with equal sets link. Rows that repeat an id and a text share their result; an
    id with several texts doesn't link them. A null id counts as larger than all; a component of
    null ids only has a null id, and keeps them. Other columns are ignored.
    """
    rows = written(signed(docs, width))
    texts = written(
        rows.groupBy(*HASHES)
        .agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
        .withColumn("k", F.monotonically_increasing_id())
    )
    groups = components(links(docs, texts, width)).withColumnRenamed("node", "k")
    placed = written(
        texts.select("k", *HASHES, "least_id", "n").join(groups, "k", "left")
        .withColumn("root", F.coalesce("root", "k"))
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("component"))
    named = placed.join(least, "root").select(*HASHES, F.when(F.col("n") > 0, F.col("component")).alias("component"), "n")
    found = rows.select("doc_id", *HASHES).join(named, [*HASHES])
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
