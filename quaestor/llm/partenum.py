"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles link when their Jaccard similarity is at least 0.8. Sizes fall into bands; sets
that link are in the same or in neighbouring bands, and every set takes part in the instance of its
own band and of the next. Within an instance, linked sets differ in at most `k` shingles. The
shingle domain is partitioned in n1 parts, each in n2 cells. At least `1 + spare` parts hold at most
k2 of the differences, and there all cells but k2 agree. So a signature, the hash of what a set has
in one choice of n2 - k2 cells of a part, is shared by every two sets that link. Nothing is lost.

A choice that is empty in a set would be shared by unrelated sets. A set with at most `spare` parts
where that can happen leaves its empty signatures out: one of its good parts is none of them.

A bucket holds the sets of one signature. In two turns its members are compared with a pivot, by parity
sketches, which bound the difference from below, and then exactly. Buckets that are one component by
then are done, so a group of near copies costs few comparisons a member. For texts in crowded buckets
that are left, the elements that none of the others has are counted: they differ in every pair. A text
with more than a fifth of them links with no other there and leaves; then others have more of them, so
they are counted anew. Pairs across components are made in one of the buckets they share, if own
elements and sizes allow the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quaestor.llm.common import map_arrow, small, text_key, text_of, written
from quaestor.llm.components import components
from quaestor.llm.pairs import BATCH_BYTES, arrow_bytes, beside, busy_texts, own_counts

WIDTH = 5
#: Rounds of comparing with pivots, and pivots of a group of copies in each.
TURNS, PIVOTS = 2, 8
#: Own elements are counted, so often, for the texts of buckets with more members than this.
CROWD, PEELS = 12, 3
#: Open signatures of a text that tell where a pair is made, and members of a bucket's block.
MARKS, BLOCK = 32, 256
#: Sampled texts, and how many of them must share a signature for its rows to be salted.
SAMPLE_ROWS, HOT_ROWS, SALTS = 4_000, 80, 64
PART_BYTES = 2_000_000

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of words; fewer words are one run, none no run."""
    words = [t.encode(errors="surrogatepass").translate(UPPER).split() for t in texts]
    flat = pa.array(list(chain.from_iterable(words)), pa.large_binary()).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.to_pylist()), "u8", len(flat.dictionary))
    h = known[flat.indices.to_numpy()]
    runs = h[: max(len(h) - width + 1, 0)].copy()
    for i in range(1, width):
        runs = runs * MIX + h[i : len(runs) + i]
    runs = mix(runs + np.uint64(width))
    out, start = [], 0
    for own in words:
        n = len(own)
        if n >= width:
            out.append(np.unique(runs[start : start + n - width + 1]))
        else:
            x = np.zeros(min(n, 1), "u8")
            for i in range(n):
                x = x * MIX + h[start + i]
            out.append(mix(x + np.uint64(n)))
        start += n
    return out


def in_parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in parts of about PART_BYTES, a row at least, with that column as text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("i8"))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + PART_BYTES, side="right")))
            part = batch.slice(start, end - start)
            yield part, part.column(column).to_pylist()
            start = end


@cache
def band_of(size: int) -> tuple[int, int, int]:
    """Band of a size, its largest size and that of the next band: linked sizes are 4 to 5 at most."""
    band, low = 0, 1
    while True:
        high = low * 5 // 4
        if size <= high:
            return band, high, (high + 1) * 5 // 4
        band, low = band + 1, high + 1


@cache
def parts_for(k: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and spare parts for sets that differ in at most k elements: n1 * (k2 + 1) > k."""
    if k <= 3:
        n2 = (1, 4, 6, 6)[k]
        return 1, n2, k, 0
    if k < 24:
        return k // 2 + 2, 4, 1, 1
    spare = 1 + (k + 1) // 8
    return k + 1 + spare, 1, 0, spare


def signatures(hashes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Signatures of a set, in the instances of its band and the next."""
    if not len(hashes):
        return np.empty(0, "u8")
    band, high, next_high = band_of(len(hashes))
    value = hashes * STEP
    value = (value ^ (value >> np.uint64(32))) * MIX
    out = []
    for instance, largest in ((band, high), (band + 1, next_high)):
        n1, n2, k2, spare = parts_for(2 * largest // 9)
        salt = mix(np.array([instance * 1_000_003 + seed + 1], "u8"))
        # hashes are even already; an odd factor deals them anew for each instance
        x = hashes * (salt | np.uint64(1))
        cell = ((x >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype("i8")
        sums = np.zeros(n1 * n2, "u8")
        np.add.at(sums, cell, value)
        filled = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2) > 0
        sums = sums.reshape(n1, n2)
        keep_empty = (filled.sum(1) <= k2).sum() > spare
        place = np.arange(n1, dtype="u8") * MIX + salt
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            sig = mix(mix(sums[:, chosen].sum(1, dtype="u8") + place) + np.uint64(c))
            out.append(sig if keep_empty else sig[filled[:, chosen].any(1)])
    return np.concatenate(out)


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Whether each of at least twice as many cells as elements holds an odd number of them."""
    bits = 64 << max(0, (2 * len(hashes) - 1).bit_length() - 6)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1")).tobytes()


def may_link(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """False only if the sets differ too much: each odd cell of the difference holds an element."""
    x, y = np.frombuffer(a, "u1"), np.frombuffer(b, "u1")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n_a + n_b


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def text_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text, k: k stands for the text."""
    return docs.select("doc_id", text_of().alias("text")).withColumn("k", text_key(F.col("text")))


def one_of_each(keyed: DataFrame) -> DataFrame:
    """k, text: copies left out, but for rows that repeat an id and a text."""
    ids = keyed.select("k", "doc_id")
    copied = written(
        ids.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")).filter("n > 1").drop("n")
    )
    marked = keyed.join(small(copied).withColumn("copied", F.lit(True)), "k", "left")
    own = F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("owner"))
    return marked.filter(own).select("k", "text")


def signed(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """sig, k, n, sketch: a row of each signature, and one of each text with n and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in in_parts(batches):
            keys = part.column("k").to_numpy()
            sets = shingle_sets(found, width)
            sigs = [signatures(x).view("i8") for x in sets]
            counts = np.array([len(x) for x in sigs])
            none = pa.nulls(int(counts.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*sigs, keys])), pa.array(np.concatenate([np.repeat(keys, counts), keys])),
                 pa.concat_arrays([none.cast(pa.int32()), pa.array([len(x) for x in sets], pa.int32())]),
                 pa.concat_arrays([none.cast(pa.binary()), pa.array([parity_sketch(x) for x in sets], pa.binary())])],
                names=["sig", "k", "n", "sketch"],
            )

    return map_arrow(texts, run, "sig long, k long, n int, sketch binary")


def hot_signatures(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """sig: signatures that HOT_ROWS of a bounded sample of texts share, thousands at most."""
    sample = texts.orderBy("k").limit(SAMPLE_ROWS)
    counts = signed(sample, width).filter("n IS NULL").groupBy("sig").agg(F.count(F.lit(1)).alias("times"))
    return written(counts.filter(F.col("times") >= HOT_ROWS).select("sig"))


def shared(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows but for signatures that only one text has; texts' own rows stay.

    Rows of hot signatures are spread over many tasks, and kept.
    """
    salted = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod("k", F.lit(SALTS))).otherwise(0)
    )
    near = Window.partitionBy("sig", "salt").orderBy("k")
    others = (F.lag("k").over(near) != F.col("k")) | (F.lead("k").over(near) != F.col("k"))
    marked = salted.withColumn("others", F.coalesce(others, F.lit(False)))
    return marked.filter(F.col("others") | F.col("hot") | F.col("n").isNotNull()).drop("salt", "hot", "others")


def may_link_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [pc.struct_field(batch.column(f"facts_{s}"), f).to_pylist() for f in ("sketch", "n") for s in "ab"]
        keep = pa.array([may_link(*row) for row in zip(*columns, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)
        keep = [linked(*(np.frombuffer(x.as_buffer(), "u8") for x in pair)) for pair in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, found in in_parts(batches):
        sets = [x.tobytes() for x in shingle_sets(found, width)]
        yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sets, pa.binary())], names=["k", "hashes"])


def bound(n_x: Column, u_x: Column, n_y: Column, u_y: Column) -> Column:
    """Whether two sets may link: own elements differ for sure, and so does what one has more of the
    others."""
    return 9 * (u_x + u_y + F.abs((n_x - u_x) - (n_y - u_y))) <= n_x + n_y


def peeled(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """k, n, u: own elements of the written texts (k, n), counted anew as those leave that have more
    than a fifth of them. No such text links with another of them."""
    for _ in range(PEELS):
        own = own_counts(sets.join(small(texts.select("k")), "k", "left_semi"))
        facts = texts.select("k", "n").join(own, "k", "left").withColumn("u", F.coalesce("u", F.lit(0)))
        texts = written(facts.filter("5 * u <= n"))
    return texts


def compare(pairs: DataFrame, info: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link: by parity sketches first, then by full sets."""
    pairs = written(pairs.distinct())
    busy = busy_texts(pairs)
    facts = info.select("k", F.struct("n", "sketch").alias("facts"))
    with arrow_bytes(pairs.sparkSession, BATCH_BYTES):
        close = written(map_arrow(beside(pairs, facts, "facts", busy), may_link_pairs, "a long, b long"))
        return written(map_arrow(beside(close, sets, "hashes", busy), linked_pairs, "a long, b long"))


def stars(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot and its other members of sizes that may link. Pivots are
    drawn by hash, PIVOTS ways, so that the buckets of one group of copies have several, but not each
    its own."""
    drawn = F.xxhash64(F.lit(turn), "k", F.pmod("sig", F.lit(PIVOTS)))
    pivots = (
        buckets.groupBy("sig").agg(F.min(F.struct(drawn, "k", "n")).alias("p"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1").select("sig", F.col("p.k").alias("k_p"), F.col("p.n").alias("n_p"))
    )
    rows = buckets.join(pivots, "sig").filter("k <> k_p AND 100 * least(n, n_p) >= 80 * greatest(n, n_p)")
    return rows.select(F.least("k", "k_p").alias("a"), F.greatest("k", "k_p").alias("b"))


def across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (sig, k, n, u, root) of different components that may link.

    One text of such a pair isn't in the bucket's main component. Where the MARKS smallest open
    signatures of both have a common one, the pair is made in the bucket of the smallest such; else
    in all buckets they share. Large buckets are cut into blocks, so no task has one alone.
    """
    sizes = members.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("sig").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("roots"),
    ).filter("roots > 1")
    opened = written(
        members.join(main.select("sig", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "sig")
    )
    marks = opened.groupBy("k").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, MARKS).alias("marks"))
    placed = written(opened.join(marks, "k"))
    columns = ("k", "n", "u", "root", "marks")
    left = placed.filter("root <> main").select(
        "sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_x") for c in columns]
    )
    right = placed.select(
        "sig", F.pmod(F.xxhash64("k"), "blocks").cast("int").alias("block"), (F.col("root") == F.col("main")).alias("in_main"),
        *[F.col(c).alias(f"{c}_y") for c in columns],
    )
    first = F.get(F.array_intersect("marks_x", "marks_y"), F.lit(0))
    may = (
        (F.col("root_x") != F.col("root_y"))
        & (F.col("in_main") | (F.col("k_x") < F.col("k_y")))
        & bound(*(F.col(c) for c in ("n_x", "u_x", "n_y", "u_y")))
        & (F.coalesce(first, left["sig"]) == left["sig"])
    )
    found = left.join(right, (left["sig"] == right["sig"]) & (left["block"] == right["block"]) & may)
    return found.select(F.least("k_x", "k_y").alias("a"), F.greatest("k_x", "k_y").alias("b"))


def links(keyed: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """info (k, n) of all texts, and links (a, b) that connect every two texts that link."""
    texts = one_of_each(keyed)
    rows = written(shared(signed(texts, width), hot_signatures(texts, width)))
    info = rows.filter("n IS NOT NULL").select("k", "n", "sketch").dropDuplicates(["k"])
    buckets = written(rows.filter("n IS NULL").select("sig", "k").distinct())
    opened = small(written(buckets.select("k").distinct()))
    own = texts.join(opened, "k", "left_semi")
    sets = written(map_arrow(own, lambda batches: set_rows(batches, width), "k long, hashes binary").dropDuplicates(["k"]))
    crowd, found = written(buckets.join(info.select("k", "n"), "k")), None
    for turn in range(TURNS):
        new = compare(stars(crowd, turn), info, sets)
        found = new if found is None else found.union(new)
        groups = small(written(components(found).withColumnRenamed("node", "k")))
        members = crowd.join(groups, "k", "left").select("sig", "k", "n", F.coalesce("root", "k").alias("root"))
        unlike = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        members = written(members.join(unlike.select("sig"), "sig", "left_semi"))
        crowd = members.drop("root")
    large = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWD).select("sig")
    crowded = written(members.join(large, "sig", "left_semi"))
    few = members.join(large, "sig", "left_anti").withColumn("u", F.lit(0).cast("long"))
    # counted among texts of crowded buckets, own elements rule out pairs there only
    rest = peeled(written(crowded.select("k", "n").distinct()), sets)
    many = crowded.select("sig", "k", "root").join(small(rest), "k")
    members = written(few.unionByName(many))
    return info.select("k", "n"), found.union(compare(across(members), info, sets))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, one row per row of docs.

    component_id is the smallest doc_id that links reach. Texts that are null, empty or without words
    have no shingles, are linked with nothing and stand for themselves. Texts with equal sets link.
    Rows that repeat an id share their text's row; an id with several texts doesn't link them. A null
    id counts as larger than all; a component of null ids only has a null id. Other columns are
    ignored.
    """
    keyed = text_classes(docs)
    info, found = links(keyed, width)
    groups = components(found).withColumnRenamed("node", "k")
    classes = keyed.groupBy("k").agg(F.min("doc_id").alias("least_id"))
    placed = written(
        info.join(groups, "k", "left").join(classes, "k").select(
            "k", "n", F.coalesce("root", "k").alias("root"), "least_id"
        )
    )
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component"))
    named = placed.join(ids, "root").select("k", F.col("n").alias("own_n"), "component")
    alone = F.col("own_n") == 0
    return keyed.select("doc_id", "k").join(named, "k").select(
        "doc_id", F.col("k").alias("text_key"), F.col("own_n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents of which none that links to them, directly or by others, has a smaller id.

    Rows that repeat an id and a text both stay; documents without words all stay, as do those of a
    component that only has null ids.
    """
    found = near_duplicates(docs, width).filter(~F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = written(found.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    key = text_key(text_of())
    return docs.join(
        small(gone), docs["doc_id"].eqNullSafe(gone["gone_id"]) & (key == gone["gone_key"]), "left_anti"
    )
