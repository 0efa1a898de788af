"""Quality by nearest neighbours: labelled documents as latent-semantic vectors vote on every document.

A text becomes counts of hashed terms: its words, runs of three character classes, and levels of how much it repeats
itself and how long it is.  Counts are damped and weighed by inverse document frequency, taken over all documents, and
projected on the main directions of the labelled documents.  Their vectors are broadcast; for each block of documents the
cosines with all of them are computed, and the nearest vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import SLICE, bounded_sample, stored, with_text_columns

#: Terms: hashed words, hashed runs of classes, levels of repetition and length.
WORDS, SHAPES, LEVELS = 1024, 992, 16
WIDTH = WORDS + SHAPES + 2 * LEVELS
#: Labelled documents of each class that are used at most, and directions kept.
SAMPLE, RANK = 2500, 96
NEIGHBOURS = 25
#: Weights of the three sorts of terms against each other.
SORTS = (1.0, 3.0, 2.0)

# classes of bytes: small and capital letters, digits, space, line ends, other bytes; marks stand for themselves
_CLASS = np.full(256, 5, np.uint32)
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 0, 1, 2
_CLASS[[9, 32]], _CLASS[[10, 13]] = 3, 4
for _mark in range(33, 127):
    if not chr(_mark).isalnum():
        _CLASS[_mark] = _mark
_SORT = np.repeat(np.array(SORTS, np.float32), (WORDS, SHAPES, 2 * LEVELS))
#: Bytes whose classes are counted at once.
BLOCK = 1 << 20


def _shapes(data: bytes) -> np.ndarray:
    counts = np.zeros(SHAPES, np.int64)
    for at in range(0, len(data), BLOCK):
        c = _CLASS[np.frombuffer(data[at : at + BLOCK + 2], np.uint8)]
        codes = (c[:-2] * np.uint32(16384) + c[1:-1] * np.uint32(128) + c[2:]) * np.uint32(2654435761)
        counts += np.bincount((codes >> np.uint32(8)) % np.uint32(SHAPES), minlength=SHAPES)
    return counts


def terms(text: str) -> np.ndarray:
    """How often each term occurs in a text, whatever its length; an empty one has its levels alone."""
    counts = np.zeros(WIDTH, np.float32)
    words = text.lower().split()
    for word, n in Counter(words).items():
        counts[zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS] += n
    counts[WORDS : WORDS + SHAPES] = _shapes(text.encode("utf-8", "surrogatepass"))
    pairs = len(words) - 1
    again = 1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs > 0 else 0.0
    counts[WORDS + SHAPES + min(LEVELS - 1, int(again * LEVELS))] = 1
    counts[WORDS + SHAPES + LEVELS + min(LEVELS - 1, len(words).bit_length())] = 1
    return counts


@dataclass
class Voters:
    """Weights of terms, main directions, and the vectors, labels and class weights of the labelled documents."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of counts; a row that no direction sees stays zero."""
        x = weighed(counts, self.idf) @ self.directions
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > 1e-6, x / np.maximum(size, 1e-6), 0.0)

    def votes(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The share of label 1 in the votes on each row.

        All labelled documents at least as near as the ``k``-th nearest vote, so ties are defined; a vote is its cosine,
        if that is above 0, over the size of its class.  Without any vote the share of label 1 in the sample is given.
        """
        if not len(self.labels):
            return np.full(len(counts), self.share)
        cosine = np.round(self.project(counts) @ self.vectors.T, 9)
        at = max(0, cosine.shape[1] - k)
        least = np.partition(cosine, at, axis=1)[:, at : at + 1]
        votes = np.where(cosine >= least, np.maximum(cosine, 0.0), 0.0)
        sizes = np.bincount(self.labels, minlength=2)
        one, both = votes @ (self.labels / max(1, sizes[1])), votes @ (1 / sizes[self.labels])
        return np.where(both > 0, np.clip(one / np.where(both > 0, both, 1), 0, 1), self.share)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts by inverse document frequency, each sort of terms of a fixed length."""
    x = np.log1p(counts).astype(np.float64) * idf
    for begin, end in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, WIDTH)):
        size = np.linalg.norm(x[:, begin:end], axis=1, keepdims=True)
        x[:, begin:end] /= np.maximum(size, 1e-12)
    return x * _SORT


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many there are; tasks add theirs up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for x in batch.column(0).slice(start, SLICE).to_pylist():
                    found += terms(x or "") > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, WIDTH), pa.int32()), pa.array([n, *found.tolist()], pa.int64())], ["term", "n"])

    rows = docs.select(text).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return np.array([counts.get(i, 0) for i in range(WIDTH)]), counts.get(-1, 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, key: str = "doc_id", text: str = "text", label: str = "quality") -> Voters:
    """Voters from documents whose keys have labels 0 or 1, at most ``sample`` documents of each class.

    Frequencies count all of ``docs``.  The labelled documents taken are those whose keys have the smallest hashes; of
    several texts of one key the one that sorts first, and of equal texts of one label one.  Null labels are left out, a
    key with both labels has label 0, null texts count as empty, and without labels every score is a half.
    """
    frequency, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + frequency)) + 0.1
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("__label"))
    chosen = stored(bounded_sample(known, key, "__label", sample))
    one = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "__label").agg(F.min(text).alias("text"))
    texts = one.groupBy("__label", F.xxhash64("text").alias("__hash")).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = [terms(x or "") for x in part.column(1).to_pylist()]
                at = [np.flatnonzero(x) for x in found]
                cells = [pa.array([i.tolist() for i in at], pa.list_(pa.int32())), pa.array([x[i].tolist() for x, i in zip(found, at, strict=True)], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cells], ["label", "hash", "at", "n"])

    rows = sorted(texts.select("__label", "text", "__hash").mapInArrow(run, "label int, hash long, at array<int>, n array<float>").collect(), key=lambda r: (r["hash"], r["label"]))
    counts = np.zeros((len(rows), WIDTH), np.float32)
    for x, r in zip(counts, rows, strict=True):
        x[r["at"]] = r["n"]
    marks = np.array([r["label"] for r in rows], np.int64)
    x = weighed(counts, idf)
    values, directions = np.linalg.eigh(x.T @ x) if len(rows) else (None, np.zeros((WIDTH, 0)))
    voters = Voters(idf, np.ascontiguousarray(directions[:, -rank:]), np.zeros((0, 0)), marks, float(marks.mean()) if len(rows) else 0.5)
    voters.vectors = voters.project(counts)
    return voters


def vote(docs: DataFrame, voters: Voters, text: str = "text", keep: Sequence[str] | None = None, k: int = NEIGHBOURS, column: str = "score") -> DataFrame:
    """``docs`` with the share of label 1 among the votes of the nearest labelled documents on each whole text.

    Null and empty texts have the levels of an empty text as their only terms.  Rows are independent: repeated rows
    repeat, an empty table stays empty, and a column of the new name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def make():
        return lambda texts: [shared.value.votes(np.array([terms(x) for x in texts], np.float32).reshape(-1, WIDTH), k).tolist()]

    return with_text_columns(docs, [(column, "double")], make, text, keep)
