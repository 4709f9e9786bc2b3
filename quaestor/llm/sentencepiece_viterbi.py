"""SentencePiece encoding and decoding by shared-prefix Viterbi.

White space is marked, and a text splits into marked words exactly: no piece of the model has a mark
after another character. The distinct words of a batch are sorted, which is the depth-first order of
their trie, and one forward pass runs over it: the states of the prefix that a word shares with the
one before are kept, and only the rest is computed. Words recur, so their ids are also kept in a
cache of bounded size.

The forward state at a prefix is its best last piece. For a unigram model that is the piece with the
largest sum of scores. For a BPE model the sum of scores doesn't give the model's segmentation;
there the state is the one piece that can follow: two pieces may be neighbours only if merging their
joined text gives these two again, and a segmentation whose neighbours all are valid is the one that
merging gives. Exactly one piece ends a prefix in such a segmentation, so the pass is exact.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from sentencepiece import SentencePieceProcessor

from quaestor.llm.common import map_arrow, slices

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_CHARS = 2_500_000
BATCH_CHARS = 1_000_000
KNOWN_PAIRS = 200_000
UNKNOWN_TEXT = " ⁇ "


class Vocabulary:
    """Pieces, scores and kinds of a model; normalisation is the model's own."""

    def __init__(self, proto: bytes):
        self.processor = model = SentencePieceProcessor(model_proto=proto)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        plain = {self.pieces[i]: i for i in ids if i not in self.special}
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece has a mark after another character; texts can't be split there")
        self.scores = {i: model.get_score(i) for i in plain.values()}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in self.special if model.is_byte(i)}
        # every ending of a piece: the piece's id, or -1 if it only ends longer ones
        self.endings = {p[k:]: -1 for p in plain for k in range(len(p))} | plain
        # unigram scores are log probabilities; those of BPE pieces are whole numbers, by rank
        self.merges = all(s == int(s) for s in self.scores.values())

    def text(self, i: int) -> str:
        """A piece, or the unknown character that a negative id stands for."""
        return self.pieces[i] if i >= 0 else chr(-1 - i)

    def settled(self, ids: list[int]) -> list[int]:
        """Unknown characters as their bytes, or as the unknown id."""
        out = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - i).encode())
            else:
                out.append(self.unknown)
        return out


class Lattice:
    """The forward pass over sorted words. The path is that of the trie's current node; for each of
    its prefixes the state is its last piece, where that begins and, for unigrams, the sum of scores."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.path = ""
        self.last: list[int | None] = [None]
        self.starts: list[int] = [0]
        self.totals: list[float] = [0.0]
        self.known: dict[int, bool] = {}
        self.forward = self.forward_merges if vocabulary.merges else self.forward_scores

    def merged(self, text: str) -> list[str]:
        """What merging neighbours, best score first and leftmost of equals, makes of a short text."""
        parts, endings, scores = list(text), self.v.endings, self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(endings.get(parts[i] + parts[i + 1], -1))
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, key: int, last: int | None, piece: int) -> bool:
        """Whether merging the joined text gives these two pieces; with no last one, this piece."""
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        parts = [self.v.text(piece)] if last is None else [self.v.text(last), self.v.text(piece)]
        ok = self.known[key] = self.merged("".join(parts)) == parts
        return ok

    def forward_merges(self, word: str, first: int) -> None:
        """The one piece that ends each prefix of `first` and more characters, shortest tried first."""
        get, lasts, starts, known = self.v.endings.get, self.last, self.starts, self.known.get
        for i in range(first, len(word) + 1):
            j = i - 1
            piece = get(word[j:i], -1)
            if piece < 0:
                piece = -1 - ord(word[j])
            while True:
                if piece >= 0 or j == i - 1:
                    last = lasts[j]
                    key = (last << 24) ^ piece if j else ~piece << 60
                    ok = known(key)
                    if ok is None:
                        ok = self.neighbours(key, last, piece)
                    if ok:
                        break
                j -= 1
                piece = get(word[j:i])
            lasts.append(piece)
            starts.append(j)

    def forward_scores(self, word: str, first: int) -> None:
        """The last piece with the largest sum of scores for each prefix; of equals the shortest."""
        get, totals, scores = self.v.endings.get, self.totals, self.v.scores
        for i in range(first, len(word) + 1):
            best, start, last = -math.inf, 0, 0
            j = i - 1
            piece = get(word[j:i], -1)
            if piece < 0:
                piece = -1 - ord(word[j])
            while piece is not None:
                if piece >= 0 or j == i - 1:
                    total = totals[j] + scores.get(piece, self.v.unknown_score)
                    if total > best:
                        best, start, last = total, j, piece
                j -= 1
                piece = get(word[j:i]) if j >= 0 else None
            self.last.append(last)
            self.starts.append(start)
            totals.append(best)

    def ids(self, word: str) -> list[int]:
        path, shared = self.path, 0
        for a, b in zip(path, word):
            if a != b:
                break
            shared += 1
        del self.last[shared + 1 :], self.starts[shared + 1 :], self.totals[shared + 1 :]
        self.forward(word, shared + 1)
        self.path = word
        out, end, lasts, starts = [], len(word), self.last, self.starts
        while end:
            out.append(lasts[end])
            end = starts[end]
        out.reverse()
        return out if min(out, default=0) >= 0 else self.v.settled(out)


class Encoder:
    """Ids of words, each computed once as long as the cache holds it."""

    def __init__(self, model: bytes):
        self.v = v = Vocabulary(model)
        self.lattice = Lattice(v)
        self.cache: dict[str, bytes] = {}  # ids of 32 bits, which join without a loop
        self.cached_chars = 0
        self.raw = [p.encode() for p in v.pieces]
        for i in v.special:
            self.raw[i] = b""
        for b, i in v.bytes.items():
            self.raw[i] = bytes([b])
        if v.unknown >= 0:
            self.raw[v.unknown] = UNKNOWN_TEXT.encode()

    def words(self, text: str) -> list[str]:
        """The text's marked words, in order; those that a single space marks, which most are, come
        without their mark and stand for themselves with it."""
        if not text:
            return []
        text = self.v.processor.normalize(text)
        if text[0] == MARK and MARK + MARK not in text and text[-1] != MARK:
            return text[1:].split(MARK)
        return [w[1:] if len(w) > 1 and w[0] == MARK != w[1] else MARK + w for w in WORD.findall(text)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are new, in trie order."""
        if self.cached_chars > CACHED_CHARS:
            self.cache.clear()
            self.cached_chars = 0
        ids, cache = self.lattice.ids, self.cache
        new = sorted(words.difference(cache))
        for w in new:
            cache[w] = array("i", ids(w[1:] if w[0] == MARK else MARK + w)).tobytes()
        self.cached_chars += sum(map(len, new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as 32-bit numbers in a row."""
        split = [self.words(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, without the mark that encoding put first."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text.removeprefix(MARK).replace(MARK, " ")


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder per worker and model; its cache lasts over tasks."""
    if model not in _ENCODERS:
        _ENCODERS[model] = Encoder(model)
    return _ENCODERS[model]


def model_bytes(model_file: str) -> bytes:
    """The model, read on the driver: executors need no copy of the file."""
    with open(model_file, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_file: str, decoded: str | None = None) -> DataFrame:
    """The documents with token_ids, array<int>, and n_tokens, long.

    An empty text has no ids, a null text null ids and n_tokens. Whole texts are encoded; one text,
    however long, is in memory at once. Every row is handled for itself, so repeated rows come out
    alike. Columns named token_ids or n_tokens are replaced, others kept. `decoded` names a further
    column for the text of the ids, as `decode_documents` gives it, made by the same workers.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_file))
    texts_again = [decoded] if decoded else []
    kept = docs.drop("token_ids", "n_tokens", *texts_again)
    place = kept.columns.index("text")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
         *[T.StructField(name, T.StringType()) for name in texts_again]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model.value)
        encode = own.encode
        for batch in batches:
            for start, end in slices(batch.column(place), BATCH_CHARS):
                part = batch.slice(start, end - start)
                texts = part.column(place).to_pylist()
                ids = encode([t or "" for t in texts])
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "i4")),
                    mask=pa.array(null),
                )
                counts = pa.array(np.diff(ends), pa.int64(), mask=null)
                again = []
                if decoded:
                    back = [None if t is None else own.decode(np.frombuffer(i, "i4").tolist()) for t, i in zip(texts, ids)]
                    again = [pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, counts, *again], names=[*part.schema.names, "token_ids", "n_tokens", *texts_again]
                )

    return map_arrow(kept, run, schema)


def decode_documents(encoded: DataFrame, model_file: str, column: str = "decoded") -> DataFrame:
    """The frame with the text of its token_ids; null ids and ids of no piece give null."""
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_file))
    kept = encoded.drop(column)
    place = kept.columns.index("token_ids")
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model.value)
        known = len(own.raw)
        for batch in batches:
            texts = []
            for row in batch.column(place):
                ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else None
                bad = ids is None or len(ids) and not (ids.min() >= 0 and ids.max() < known)
                texts.append(None if bad else own.decode(ids.tolist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, column]
            )

    return map_arrow(kept, run, schema)
