"""Fill-in-the-middle and nearest-neighbour votes against brute force and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkedframe.llm import fillmiddle, neighbours, queries
from linkedframe.llm.common import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, form string, score double, output string"
ODD = ["", " ", None, "a", "Ab " * 70_000, "x" * 3_000_000, "é" * 500, "日本 text 😀😀", "<P> a <S> b <M>", "ends in <", "<S", "<S<P<M", "a\nb\r\n"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "mine", 9.0, "o") for i, t in enumerate(ODD * 6)] + [(3, "a", 7, "mine", 9.0, "o"), (None, "null key and words", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_middle(key, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h[3] % 100 < 20 else "psm", out, len(pre), len(mid)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zb" * 90, " ", "é", "\n", "😀", "word", "x" * 3000]), max_size=400))
def test_rank_index(parts):
    text = "".join(parts)
    index = fillmiddle.RankIndex.fit(text)
    ends = [0, *(m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text))]
    assert index.tokens == len(ends) - 1 and [index.offset(k) for k in range(len(ends))] == ends
    assert all(x.dtype == np.int8 and np.abs(x.astype(int)).max() <= fillmiddle.ERROR + 1 for x in index.residuals)


def test_rank_index_in_blocks(monkeypatch):
    monkeypatch.setattr(fillmiddle, "BLOCK", 5)
    text = "abcdefgh ij, klmnopqrstuvwxyzabc 12é" * 3
    index = fillmiddle.RankIndex.fit(text)
    ends = [0, *(m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text))]
    assert [index.offset(k) for k in range(index.tokens + 1)] == ends


def test_pieces_are_few():
    index = fillmiddle.RankIndex.fit("some words of much the same length, and so on. " * 5000)
    assert index.tokens > 90_000 and len(index.ranks) < 10


def test_fill_middle(spark, odd):
    docs = read_table(spark, SF, "documents", "doc_id", "text").unionByName(odd.select("doc_id", "text"))
    found = fillmiddle.fill_in_middle(docs).withColumn("again", fillmiddle.restored())
    got = Counter((r["doc_id"], r["again"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in found.collect())
    assert got == Counter((r["doc_id"], r["text"] or "", *brute_middle(r["doc_id"], r["text"])) for r in docs.collect())
    assert {x[3] for x in got} == {"plain", "psm", "spm"}
    assert fillmiddle.fill_in_middle(odd.limit(0)).count() == 0
    assert fillmiddle.fill_in_middle(odd).columns == ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]


def brute_terms(text):
    """Term counts by their definition, one window of three bytes at a time."""
    counts = np.zeros(neighbours.WIDTH)
    words = text.lower().split()
    for w in words:
        counts[zlib.crc32(w.encode()) % neighbours.WORDS] += 1

    def kind(b):
        c = chr(b)
        return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in "\t " else 4 if c in "\r\n" else b if 32 < b < 127 else 5

    data = [kind(b) for b in text.encode()]
    for x, y, z in zip(data, data[1:], data[2:], strict=False):
        counts[neighbours.WORDS + (((x * 16384 + y * 128 + z) * 2654435761 % (1 << 32)) >> 8) % neighbours.SHAPES] += 1
    pairs = list(zip(words, words[1:], strict=False))
    again = 1 - len(set(pairs)) / len(pairs) if pairs else 0
    base = neighbours.WORDS + neighbours.SHAPES
    counts[base + min(15, int(again * 16))] = 1
    counts[base + 16 + min(15, len(words).bit_length())] = 1
    return counts


def test_terms_by_brute_force(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    for text in ["", "a", "ab", "It was, it WAS 12 times\n\né ###", "日本語 x y z | a | b"]:
        assert np.array_equal(neighbours.terms(text), brute_terms(text))


def test_frequencies_count_all_documents(spark, odd):
    docs = read_table(spark, SF, "documents", "doc_id", "text")
    found, n = neighbours.document_frequencies(docs.repartition(5))
    texts = [r["text"] or "" for r in docs.collect()]
    assert n == len(texts) and np.array_equal(found, sum(neighbours.terms(t) > 0 for t in texts))
    assert neighbours.document_frequencies(docs.limit(0))[1] == 0


def test_votes_by_brute_force(spark):
    voters = queries.quality_voters(spark, SF)
    texts = [r["text"] or "" for r in read_table(spark, SF, "documents", "text").collect()]
    got = voters.votes(np.array([neighbours.terms(t) for t in texts], np.float32), 5)
    sizes = Counter(voters.labels.tolist())
    for text, score in zip(texts, got, strict=True):
        x = voters.project(neighbours.terms(text)[None])[0]
        cosine = [round(float(x @ v), 9) for v in voters.vectors]
        least = sorted(cosine, reverse=True)[min(5, len(cosine)) - 1]
        votes = [(max(c, 0) / sizes[y], y) for c, y in zip(cosine, voters.labels.tolist(), strict=True) if c >= least]
        total = sum(w for w, _ in votes)
        assert score == pytest.approx(sum(w for w, y in votes if y) / total if total else voters.share, abs=1e-6)


def test_directions_keep_most_of_the_vectors(spark):
    """Projections are onto the main directions: no other 96 keep more of the labelled documents."""
    voters = queries.quality_voters(spark, "/root/testdata/sf0.01")
    assert np.allclose(voters.directions.T @ voters.directions, np.eye(voters.directions.shape[1]), atol=1e-8)
    assert np.allclose(np.linalg.norm(voters.vectors, axis=1), 1) and voters.vectors.shape[1] == neighbours.RANK


@pytest.mark.parametrize(("sf", "accuracy"), [("sf0.1", 0.97), ("sf0.01", 0.93)])
def test_quality_held_out(spark, sf, accuracy):
    path = f"/root/testdata/{sf}"
    known = read_table(spark, path, "labels", "doc_id", "quality").where("quality IS NOT NULL")
    rows = queries.op13_quality_votes(spark, path).where("held_out").join(known, "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= accuracy * len(rows)
    bad, good = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert np.mean([[(g > b) + (g == b) / 2 for g in good] for b in bad]) > 0.97


def test_votes_odd(spark, odd):
    voters = queries.quality_voters(spark, SF)
    rows = neighbours.vote(odd, voters).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1 and neighbours.vote(odd, voters).columns == [*(c for c in odd.columns if c != "score"), "score"]
    assert neighbours.vote(odd.limit(0), voters).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in neighbours.vote(odd, neighbours.train(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    single = neighbours.train(odd, one)
    assert sorted(single.labels.tolist()) == [0, 1, 1] or sorted(single.labels.tolist()) == [0, 1]
    assert all(0 <= r["score"] <= 1 for r in neighbours.vote(odd, single).collect())
    assert neighbours.train(odd.limit(0), one).share == 0.5


def test_query_columns(spark):
    docs = read_table(spark, SF, "documents", "doc_id")
    for name in ("op11_fill_middle", "op13_quality_votes"):
        assert queries.QUERIES[name](spark, SF).select("doc_id").exceptAll(docs).isEmpty()
    held = queries.op13_quality_votes(spark, SF).select("held_out", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("want"))
    assert held.where("held_out <> want").isEmpty()
