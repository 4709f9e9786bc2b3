"""Language ID by compression: the language whose raw-content zstandard dictionary makes a text smallest.

Per language a dictionary of bounded size is filled with pieces of a bounded sample of labelled
texts. A text is brought to letters and single spaces and compressed whole, in parts, since within a
long part the text's own beginning would stand in for the dictionary. Where the second language
comes close, the text is rejected.

The fit takes at most SAMPLE_ROWS different texts per language, those of smallest hash in a share of
all hashes that about DRAWN times as many different texts have, and PIECE_CHARS of each. Rows outside the share leave
no task, so a language that most rows have doesn't meet in one. The dictionaries, DICTIONARY_BYTES
for each language, are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quaestor.llm.common import map_arrow, small, written

SAMPLE_ROWS = 400
DRAWN = 8
PIECE_CHARS = 512
DICTIONARY_BYTES = 131_072
PART_BYTES = 4_096
LEVEL = 3
#: Relative margin between the two smallest sizes below which a text is rejected.
MARGIN = 0.01
UNKNOWN = "und"

NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> str:
    """Lower-case letters, all else as single spaces."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


@dataclass
class LanguageModel:
    """Dictionaries by language, in order of their names."""

    dictionaries: dict[str, bytes]
    compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "compressors": []}

    def sizes(self, text: bytes) -> np.ndarray:
        """Bytes that the text takes with each language's dictionary."""
        if not self.compressors:
            for content in self.dictionaries.values():
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self.compressors.append(
                    zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
                )
        parts = [text[i : i + PART_BYTES] for i in range(0, len(text), PART_BYTES)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Best language, score and relative margin. The score is what each byte saved, as a factor
        of two, makes of the languages' shares."""
        plain = letters(text or "").encode()
        if not plain or not self.dictionaries:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(plain)
        best = int(sizes.argmin())
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else 2 * sizes[best]
        score = 1.0 / float(np.exp2(np.clip(sizes[best] - sizes, -60, 0).astype("f8")).sum())
        return list(self.dictionaries)[best], score, float((second - sizes[best]) / second)


def fit(labelled: DataFrame) -> LanguageModel:
    """Dictionaries from rows with text and lang; rows without either or without letters are left out.

    Equal rows count once, so copies don't fill a dictionary. No rows give a model of no language.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64(F.lit(1), "text")).alias("n"))
    # Few tasks' worth of rows come into question: those in a share of all hashes.
    share = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.select("lang", "text", share.alias("share")).join(small(written(sizes)), "lang")
    pieces = drawn.filter(F.col("share") * F.col("n") <= DRAWN * SAMPLE_ROWS).select(
        "lang", F.xxhash64("text").alias("hash"), F.left("text", F.lit(PIECE_CHARS)).alias("piece")
    )
    order = Window.partitionBy("lang").orderBy("hash", "piece")
    rows = (
        pieces.distinct().withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= SAMPLE_ROWS)
        .drop("rank")
        .toPandas()
        .sort_values(["lang", "hash", "piece"])
    )
    pieces = {lang: [letters(p) for p in own] for lang, own in rows.groupby("lang", sort=True)["piece"]}
    return LanguageModel({k: " ".join(v).encode()[:DICTIONARY_BYTES] for k, v in pieces.items()})


def identify(docs: DataFrame, model: LanguageModel, margin: float = MARGIN) -> DataFrame:
    """The documents with lang_best, score (0 to 1), margin and lang_pred, which is lang_best or, where
    the relative margin is below `margin`, `und`.

    Texts that are null, empty or without a letter are `und` with score 0, as are all with a model of
    no language. Equal sizes go to the first language by name. Whole texts count. Each row is handled
    for itself; lang, source and doc_id are not looked at. Columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = T.StructType(
        [T.StructField("lang_best", T.StringType()), T.StructField("score", T.DoubleType()),
         T.StructField("margin", T.DoubleType()), T.StructField("lang_pred", T.StringType())]
    )
    kept = docs.drop(*new.names)
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(place)]
            best, score, gap = (list(x) for x in zip(*found)) if found else ([], [], [])
            sure = [b if g >= margin else UNKNOWN for b, g in zip(best, gap, strict=True)]
            columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(sure, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *new.names]
            )

    return map_arrow(kept, run, T.StructType([*kept.schema.fields, *new.fields]))
