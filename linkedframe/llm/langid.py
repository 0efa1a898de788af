"""Language identification by the nearest of several centroids of each language.

A text is the TF-IDF vector of its hashed character n-grams (one to three characters, lower case, one space for each
run of other characters), normalised.  Each language's training vectors are clustered by spherical k-means; the language
of a text is that of the centroid with the largest cosine.  A text farther from its centroid than nearly all training
texts of that cluster is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import bounded_sample, with_text_columns

WIDTH = 4096
#: Training texts of all languages together, and centroids of each language.
SAMPLE, CENTROIDS = 4000, 4
#: Share of a cluster's training texts that may be farther away than its radius.
OUTSIDE = 0.01


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    radius: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams; no letter: all zero."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(WIDTH, np.float32)
    codes = np.where(letter, codes, np.uint32(32))[np.concatenate([[True], letter[1:] | letter[:-1]])]
    one = codes * np.uint32(2654435761)
    two = (one[:-1] ^ codes[1:]) * np.uint32(2246822519)
    three = (two[:-1] ^ codes[2:]) * np.uint32(3266489917)
    return np.bincount(np.concatenate([one, two, three]) >> np.uint32(20), minlength=WIDTH).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, started from the mean and then the texts farthest from all centroids."""
    start = [x.mean(axis=0)]
    while len(start) < min(k, len(x)):
        start.append(x[np.argmin(np.max(x @ np.array(start).T, axis=1))])
    c = np.array(start)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from rows with a language, at most ``sample`` of them, or one of each language where there are more of these.

    Each language has an equal share of the sample, the rows whose keys have the smallest hashes, and of several texts of
    one key the one that sorts first.  Their n-grams are counted on the executors; the driver gets vectors of fixed width.  Null texts count as empty, null
    languages are left out, and no row at all gives a model that answers ``und``.
    """
    rows = labelled.where(F.col(lang).isNotNull())
    languages = [r[0] for r in rows.groupBy(lang).count().orderBy(lang).select(lang).collect()]
    if not languages:
        return Model(np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), [], np.zeros(0))
    chosen = bounded_sample(rows.select(key, lang).distinct(), key, lang, max(1, sample // len(languages)))
    texts = rows.select(F.col(key), F.col(lang), text).join(F.broadcast(chosen), [key, lang]).groupBy(key, lang).agg(F.min(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [zstandard.compress(counts(x or "").tobytes(), 1) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["lang", "tf"])

    found = texts.select(F.col(lang).alias("lang"), text).mapInArrow(run, "lang string, tf binary").collect()
    found = sorted((r["lang"], zstandard.decompress(r["tf"])) for r in found)
    rows = [(lang, np.frombuffer(x, np.float32)) for lang, x in found if any(x)]
    tf = np.array([x for _, x in rows], np.float32).reshape(-1, WIDTH)
    names = np.array([lang for lang, _ in rows])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = vectors(tf, idf)
    all_c, all_l, radius = [], [], []
    for language in sorted(set(names)):
        own = x[names == language]
        c = _clusters(own, centroids)
        cosine = own @ c.T
        near, best = cosine.argmax(axis=1), cosine.max(axis=1)
        all_c.append(c)
        all_l += [language] * len(c)
        radius += [float(np.quantile(1 - best[near == i], 1 - OUTSIDE)) if (near == i).any() else 1.0 for i in range(len(c))]
    return Model(idf, np.concatenate(all_c).astype(np.float32) if all_c else np.zeros((0, WIDTH), np.float32), all_l, np.array(radius))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine of the nearest centroid, 0 to 1) and ``rejected``.

    Null and empty texts and texts without a letter are ``und`` with score 0 and rejected.  Ties go to the language that
    sorts first.  Rows are independent: repeated rows repeat, an empty table stays empty, columns of these names are
    replaced, and each text counts whole.
    """

    def make():
        def function(texts):
            tf = np.array([counts(x) for x in texts], np.float32).reshape(-1, WIDTH)
            letters = tf.any(axis=1)
            if not len(model.centroids):
                return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            cosine = vectors(tf, model.idf) @ model.centroids.T
            near, best = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1)
            names = [model.languages[i] if k else "und" for i, k in zip(near, letters, strict=True)]
            far = (1 - best > model.radius[near]) | ~letters
            return names, np.where(letters, best, 0).astype(float).tolist(), far.tolist()

        return function

    return with_text_columns(docs, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], make, text, keep)
