"""SimHash near-duplicates: fingerprints, a trie self-join of the distinct ones, and the components of their links.

Two fingerprints of 64 bits that differ in at most k bits agree on at least b - k of any b blocks of bits.  For each
choice of b - k blocks, fingerprints with equal blocks meet in one group; a sorted group is a binary trie, whose nodes
are ranges, and is joined with itself: pairs of trie nodes descend together, each step adds the bit in which they differ,
and a pair goes as soon as these exceed k.  Where both nodes are down to one fingerprint each, the rest of both paths is
one edge, whose bits are compared at once.  A group yields one link from each linked fingerprint to the smallest one it
reaches there, never its pairs.  Groups above a bound are dealt to pairs of parts, which are joined part by part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import join_counted, stored, with_text_columns

BITS = 64
#: Distinct fingerprints in a group that one task joins; larger groups are dealt out in parts.
GROUP = 100_000
#: Pairs of trie nodes that are taken down a level at once.
FRONTIER = 200_000
#: Times that the smaller side of a join by node is repeated, so that rows of one node go to as many tasks.
SALTS = 16
#: Rows of small groups that are joined in one call.
CALL = 50_000


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles of a text, as a signed number.  No words: 0."""
    parts = text.encode().lower().split()  # bytes: only A-Z change, and only the six ASCII white-space bytes part words
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[: -words].tolist()]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    array = np.array(hashes, "<u8")
    for i in range(0, len(array), 60_000):
        counts += np.unpackbits(array[i : i + 60_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, keep=None) -> DataFrame:
    """``docs`` with ``fp``, in one pass without a shuffle.  Null and empty texts have fingerprint 0."""
    return with_text_columns(docs, [("fp", "long")], lambda: lambda texts: [[fingerprint(x, words) for x in texts]], text, keep)


def descend(values: np.ndarray, edges: np.ndarray, budget: int, link) -> int:
    """Trie self-join of each group of values, sorted within ``edges``; the number of node pairs that were taken apart.

    A pair is (low, high, low, high, bits that differ so far), two nodes of one group and depth.  ``link`` gets arrays
    of linked indexes.
    """
    zeros: dict[int, np.ndarray] = {}
    low, high = edges[:-1], edges[1:]
    stack = [(0, np.column_stack([low, high, low, high, np.zeros_like(low)]))]
    steps = 0
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(depth, pairs[i : i + FRONTIER]) for i in range(0, len(pairs), FRONTIER)]
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        i, j = pairs[single][:, 0], pairs[single][:, 2]
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        link(i[near], j[near])
        pairs = pairs[~single]
        if not len(pairs):
            continue
        steps += len(pairs)
        if depth not in zeros:
            zeros[depth] = np.concatenate([[0], np.cumsum(values >> np.uint64(BITS - 1 - depth) & np.uint64(1) ^ np.uint64(1))]).astype(np.int64)
        zero = zeros[depth]
        a_lo, a_hi, b_lo, b_hi, bits = pairs.T
        a_mid, b_mid = a_lo + zero[a_hi] - zero[a_lo], b_lo + zero[b_hi] - zero[b_lo]
        same = a_lo == b_lo
        below = np.concatenate(
            [
                np.column_stack([a_lo, a_mid, b_lo, b_mid, bits]),
                np.column_stack([a_mid, a_hi, b_mid, b_hi, bits]),
                np.column_stack([a_lo, a_mid, b_mid, b_hi, bits + 1]),
                np.column_stack([a_mid, a_hi, b_lo, b_mid, bits + 1])[~same],
            ]
        )
        stack.append((depth + 1, below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]))
    return steps


def trie_links(values: np.ndarray, edges: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (value, smallest value of its component) in groups of sorted distinct values, and the steps taken."""
    root = np.arange(len(values))
    kept: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        """Joins the components of the links gathered so far."""
        nonlocal root, held
        if not kept:
            return
        a, b = np.concatenate(kept, axis=1)
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while not np.array_equal(root, root[root]):
                root = root[root]
            if np.array_equal(root, before):
                break
        kept.clear()
        held = 0

    def link(i, j) -> None:
        nonlocal held
        new = root[i] != root[j]
        if new.any():
            kept.append(np.stack([i[new], j[new]]))
            held += int(new.sum())
            if held > 1_000_000:
                settle()

    steps = descend(values, edges, budget, link) if len(values) else 0
    settle()
    linked = root != np.arange(len(values))
    return values[linked], values[root[linked]], steps


def _group_links(budget: int):
    """Links of all groups in a table (choice, key, i, j, fp), and a row with the steps taken."""

    def run(table: pa.Table) -> pa.Table:
        *names, fps = (table.column(c).to_numpy() for c in ("choice", "key", "i", "j", "fp"))
        fps = fps.view(np.uint64)
        order = np.lexsort((fps, *names))
        change = np.zeros(max(0, len(order) - 1), bool)
        for x in names:
            change |= np.diff(x[order]) != 0
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(order)]]).astype(np.int64)
        low, high, steps = trie_links(fps[order], edges, budget)
        columns = [[*x.view(np.int64).tolist(), None] for x in (low, high)]
        return pa.table([*(pa.array(x, pa.int64()) for x in columns), pa.array([None] * len(low) + [steps], pa.int64())], ["u", "v", "steps"])

    return run


def trie_join(distinct: DataFrame, budget: int = 4, group: int = GROUP, n: int | None = None) -> DataFrame:
    """(u, v, steps): links that connect the distinct fingerprints ``fp`` as all pairs within ``budget`` bits would.

    Rows without a link have the trie steps of one call.  The number of blocks follows the number of fingerprints, so groups stay small as the corpus grows.
    """
    n = distinct.count() if n is None else n
    blocks = budget + (1 if n < 1 << 26 else 2 if n < 1 << 34 else 3)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - budget)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))
    sizes = keys.groupBy("choice", "key").count().where(F.col("count") > 1)
    dealt = keys.join(sizes, ["choice", "key"]).withColumn("parts", F.greatest(F.lit(1), F.ceil(2 * F.col("count") / group).cast("int")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    # a group in one part is joined with itself; else each part meets each other part
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")),
            lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")),
        )
    )
    units = dealt.withColumn("own", own.cast("int")).select("choice", "key", "fp", F.explode(pairs).alias("unit"))
    calls = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(masks) * n // CALL)
    named = units.select(F.pmod(F.xxhash64("choice", "key", "unit"), F.lit(calls)).alias("call"), "choice", "key", "unit.i", "unit.j", "fp")
    return named.groupBy("call").applyInArrow(_group_links(budget), "u long, v long, steps long")


def links(distinct: DataFrame, budget: int = 4, group: int = GROUP, n: int | None = None) -> DataFrame:
    """The links (u, v) of :func:`trie_join`, each once."""
    return trie_join(distinct, budget, group, n).where("u IS NOT NULL").select("u", "v").distinct()


def _by_node(rows: DataFrame, table: DataFrame, node: str) -> DataFrame:
    """``rows`` joined to a ``table`` with one row a node; those of one node are spread over several tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [node, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of ``edges`` (u, v); nodes without an edge are left out.

    Each round hangs all neighbours of a node on the smallest one, first the larger neighbours, then the smaller ones,
    until nothing changes; links of all nodes stay on the executors, and each round is written to the checkpoint folder.
    """
    current = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _by_node(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _by_node(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(current.select("v", "v").distinct())
        before = state


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4, group: int = GROUP) -> DataFrame:
    """(key, fp, component_id) of each row: its fingerprint and the smallest key among all rows it is linked to.

    Null and empty texts have fingerprint 0 and are linked like others.  Rows of one fingerprint are one node, so copies
    are never paired.  Null keys are kept but never name a component unless it has no other.  An empty table gives an
    empty one; other columns are left out.
    """
    marked = stored(fingerprints(docs, text, words, keep=[key]))
    nodes = stored(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    labels = components(links(nodes.select("fp"), budget, group))
    linked = stored(nodes.join(labels.withColumnRenamed("node", "fp"), "fp"))
    least = stored(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    joined = join_counted(linked.select("fp", "label"), least, "label").select("fp", "component_id")
    classes = stored(nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"))
    return join_counted(marked, classes, "fp").select(key, "fp", "component_id")
