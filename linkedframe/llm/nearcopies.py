"""Near copies by the Jaccard similarity of shingle sets.

Texts of one set of five-word shingles are one node. Candidates are nodes whose SimHash fingerprints are linked by the
trie join of ``simhash.py``, and, since similar sets may differ in more bits than it allows, nodes that agree in a band
of minimum hashes: two sets of similarity s share no band with probability (1 - s ** ROWS) ** BANDS, less than 3 in
100,000 at 0.8. Candidates are linked only if their whole sets are similar enough, compared on the executors. Within a
group of candidates all pairs of different components are compared, so its links connect it as all its similar pairs
would; groups above a bound are dealt to pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm import simhash
from linkedframe.llm.common import join_counted, stored, with_text_columns
from linkedframe.llm.simhash import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Shingles in a group of candidates that one task compares; larger groups are dealt out in parts.
GROUP = 4_000_000
#: Shingles of small groups that are compared in one call.
CALL = 2_000_000

_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 of all shingles of a text, words as in SimHash; a shorter text is one shingle, no words none."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    stops = (ends[words - 1 :] - 1).tolist() if len(parts) >= words else [len(line)]
    return np.unique(np.array([digest(line[a:b]) for a, b in zip([0, *ends[: n - 1].tolist()], stops, strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One hash for each band of minimum hashes, as signed numbers; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 20_000):
        least = np.minimum(least, (hashes[None, i : i + 20_000] * _FACTORS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes()) for band in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64).tolist()


def similar_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (i, j) that connect sorted sets as all pairs of at least this similarity would."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owners = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    begins, edges = np.cumsum(counts) - counts, np.cumsum([0, *sizes])
    root, groups, found = np.arange(n), n, []
    for x in range(n):
        if groups == 1:
            break
        own = codes[edges[x] : edges[x + 1]]
        wide = counts[own]
        at = np.repeat(begins[own] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        shared = np.bincount(owners[at], minlength=n)
        for y in np.flatnonzero(shared / np.maximum(1, sizes + sizes[x] - shared) >= similarity).tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                groups -= 1
                found.append((x, y))
    return found


def _group_links(similarity: float):
    """Links of all groups in a table (band, key, i, j, node, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        names = [table.column(c).to_numpy() for c in ("band", "key", "i", "j")]
        nodes, raw = table.column("node").to_numpy(), table.column("shingles").to_pylist()
        order = np.lexsort(names)
        change = np.zeros(len(order) - 1, bool)
        for x in names:
            change |= np.diff(x[order]) != 0
        u, v = [], []
        for part in np.split(order, np.flatnonzero(change) + 1):
            for a, b in similar_links([np.frombuffer(raw[k], np.uint64) for k in part.tolist()], similarity):
                u.append(nodes[part[a]])
                v.append(nodes[part[b]])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def candidates(marked: DataFrame) -> DataFrame:
    """(node, hash, size, band, key): nodes of one band and key are a group of candidates; ``BANDS`` is that of linked fingerprints."""
    nodes = stored(marked.where("size > 0").groupBy("node").agg(F.min("hash").alias("hash"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    # texts of one set may repeat its shingles differently, so a node can have several fingerprints
    prints = stored(marked.where("size > 0").select("node", "fp").distinct())
    counts = stored(prints.groupBy("fp").agg(F.count("*").alias("n")))
    labels = components(simhash.links(counts.select("fp"))).withColumnRenamed("node", "fp")
    classes = stored(counts.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("key"), "n"))
    linked = join_counted(prints, classes, "fp").select("node", "key").distinct()
    by_print = nodes.drop("bands").join(linked, "node").select("node", "hash", "size", F.lit(BANDS).alias("band"), "key")
    return nodes.select("node", "hash", "size", F.posexplode("bands").alias("band", "key")).unionByName(by_print)


def links(docs: DataFrame, marked: DataFrame, text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """Links (u, v) between nodes of ``marked`` (hash, node, size, bands, fp), whose sets are made anew from texts of ``docs``."""
    keys = stored(candidates(marked))
    found = keys.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("mark")
    )
    # bands that bring the same nodes together are one group
    once = found.where("n > 1").groupBy("n", "weight", "low", "high", "mark").agg(F.min(F.struct("band", "key")).alias("g"))
    parts = F.greatest(F.lit(1), F.ceil(2 * F.col("weight") / group)).cast("int")
    members = stored(join_counted(keys, stored(once.select("g.band", "g.key", parts.alias("parts"), "n")), ["band", "key"]))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a group in one part is compared with itself; else each part meets each other part
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")),
            lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")),
        )
    )
    units = members.withColumn("own", own).select("band", "key", "node", F.explode(pairs).alias("unit"))
    total = members.agg(F.sum(F.col("size") * F.greatest(F.lit(1), F.col("parts") - 1))).first()[0] or 0
    calls = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // CALL)
    named = units.select(F.pmod(F.xxhash64("band", "key", "unit"), F.lit(calls)).alias("call"), "band", "key", "unit.i", "unit.j", "node")

    def make():
        return lambda texts: [[shingles(x).tobytes() for x in texts]]

    wanted = members.select("hash", "node").distinct()
    texts = docs.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).join(wanted, "hash").groupBy("node").agg(F.min("text").alias("text"))
    sets = with_text_columns(texts, [("shingles", "binary")], make, "text", ["node"])
    return named.join(sets, "node").groupBy("call").applyInArrow(_group_links(similarity), "u long, v long").distinct()


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, node, size, bands, fp) of each row, in one pass without a shuffle."""

    def make():
        def function(texts):
            sets = [shingles(x) for x in texts]
            return [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], [len(s) for s in sets], [bands(s) for s in sets], [simhash.fingerprint(x) for x in texts]

        return function

    hashed = docs.select(key, text, F.xxhash64(text).alias("hash"))
    return with_text_columns(hashed, [("node", "long"), ("size", "long"), ("bands", "array<long>"), ("fp", "long")], make, text, [key, "hash"])


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """(key, text_hash, component_id, first, times) of each row: the smallest key among all rows its text is linked to.

    ``first`` marks the rows that stand for their component: those of the smallest key, nulls last, and of its texts the
    one with the smallest hash.  ``times`` is how many rows of that key and text there are, which this cannot tell apart.

    Null and empty texts, and others without a word, are copies of each other.  Null keys are kept but never name a
    component unless it has no other.  An empty table gives an empty one; other columns are left out.
    """

    marked = stored(marks(docs, key, text))
    labels = components(links(docs, marked, text, similarity, group))
    nodes = marked.groupBy("node").agg(F.count("*").alias("n")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = stored(join_counted(marked.select(key, F.col("hash").alias("text_hash"), "node"), stored(nodes), "node").select(key, "text_hash", "label"))
    texts = rows.groupBy("label", key, "text_hash").agg(F.count("*").alias("times"))
    rank = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col("text_hash").alias("hash"), "times")
    first = stored(texts.groupBy("label").agg(F.min(key).alias("component_id"), F.min(rank).alias("least"), F.sum("times").alias("n")))
    return join_counted(rows, first, "label").select(
        key, "text_hash", "component_id", (F.col(key).eqNullSafe(F.col("least.key")) & (F.col("text_hash") == F.col("least.hash"))).alias("first"), F.col("least.times").alias("times")
    )
