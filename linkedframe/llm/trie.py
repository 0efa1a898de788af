"""The trie of conversation prefixes, all its nodes from ROLLUP over positional columns of turn ids.

1. Turns are sorted in ranges of (conversation, turn), so that a long conversation is many tasks; a turn's place within
   its conversation follows from the numbers of turns in the ranges before it.  Its id is its MD5 and its size.
2. Each stretch of ``WIDTH`` turns is a row with the ids in columns, and the key of the node where it begins.  One
   ``GROUP BY block, key, ROLLUP (t1, ...)`` then has a group for each prefix, ``grouping_id`` tells how long it is, and
   conversations are added up in the tasks that read them.  Keys follow from the ids alone, so the blocks of long
   conversations need no rounds.
3. A second rollup, over nodes, adds up what hangs below each.  What the blocks below a block hold reaches it in
   log2(blocks) rounds, each over twice as many blocks as the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkedframe.llm.common import join_counted, stored

#: Turns in a row of columns; blocks whose keys are added up in one window; conversations whose ids are joined at once.
WIDTH, REACH, TOGETHER = 8, 512, 1024
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
#: A rebuilt conversation begins with at most this many turns, less one, of the first in its group of ``GROUP``.
HEADS, GROUP = 9, 5
_PLACE = (1 << 33) - 1
#: What nodes are told apart by: how deep they are, and two hashes of their turns.
NODE = ["depth", "u", "v"]


def placed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The stored turns (conv_id, place, a, b, bytes): ``place`` ascends in the order of (conv, turn, role, text), nulls first.

    Its upper bits are the number of the range.  Null roles and texts are empty; rows without a conversation are left out.
    """
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    # a range is found by the start of the text, so that a sample of bounds stays small; within it whole texts are compared
    dealt = rows.repartitionByRange("conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    halves = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(name) for name, at in (("a", 1), ("b", 16))]
    return stored(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")).select("conv_id", "place", *halves, "bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, length, a, b, bytes) of each turn of the rebuilt conversations, and the ids of those without turns.

    Conversation c begins with the first h turns of conversation c - c % 5, all if it has fewer, and goes on with its own
    turns behind its first h; h is the CRC-32 of c in decimal, modulo 9.
    """
    parts = turns.withColumn("range", F.shiftright("place", 33))
    spans = stored(parts.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")
    sizes = spans.groupBy("conv_id").agg(F.sum("n").alias("total")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    k = F.least("h", F.coalesce("base_total", F.lit(0)))
    convs = stored(sizes.join(bases, "base", "left").select("conv_id", "base", "h", k.alias("k"), (k + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")))
    heirs = convs.groupBy(F.col("base").alias("conv_id")).agg(F.collect_list(F.struct("conv_id", "h", "length")).alias("heirs"))  # nine at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = stored(spans.withColumn("before", before).join(convs.drop("base").join(heirs, "conv_id", "left"), "conv_id"))
    at = join_counted(parts, known, ["conv_id", "range"]).withColumn("pos", F.col("place") - F.col("first") + F.col("before"))
    own = F.when(F.expr("pos >= h"), F.array(F.struct("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("at"), "length")))
    given = F.expr("transform(filter(heirs, x -> x.h > pos), x -> named_struct('conv_id', x.conv_id, 'at', pos, 'length', x.length))")
    none = F.array().cast("array<struct<conv_id: bigint, at: bigint, length: bigint>>")
    rows = at.select(F.explode(F.concat(F.coalesce(own, none), F.coalesce(given, none))).alias("r"), "a", "b", "bytes")
    return rows.select("r.*", "a", "b", "bytes"), convs.where("length = 0").select("conv_id")


def _hashes(*columns: Column | str) -> list[Column]:
    """Two hashes of a block's number and turns."""
    return [F.xxhash64(F.lit(i), F.col("block"), *columns) for i in (0, 1)]


def blocks(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """The stored rows (conv_id, block, length, t1 ..., u, v, p, q) of each ``WIDTH`` turns of a conversation.

    (u, v) are hashes of the block, (p, q) those of all blocks before it, joined by XOR: the key of the node where it
    begins.  They are joined in two levels, so no window has more than ``REACH`` blocks or a row for as many.
    """
    block = F.expr(f"at div {WIDTH}")
    cells = [F.max(F.when(F.col("at") % WIDTH == i, F.col(c))).alias(f"{c}{i + 1}") for i in range(WIDTH) for c in ("a", "b", "bytes")]
    wide = turns.groupBy("conv_id", "length", block.alias("block")).agg(*cells)
    ids = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"bytes{i}").alias("bytes"))).alias(f"t{i}") for i in range(1, WIDTH + 1)]
    u, v = _hashes(*TURNS)
    rows = stored(wide.select("conv_id", "block", "length", *ids).withColumns({"u": u, "v": v}))
    begun = {"p": F.lit(0).cast("long"), "q": F.lit(0).cast("long")}
    short = rows.where(F.col("length") <= WIDTH).withColumns(begun)
    long = rows.where(F.col("length") > WIDTH).withColumn("stretch", F.expr(f"block div {REACH}"))

    def before(window):
        return {c: F.coalesce(F.bit_xor(x).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c, x in (("p", "u"), ("q", "v"))}

    far = long.where(F.col("length") > WIDTH * REACH).groupBy("conv_id", "stretch").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"))
    far = far.withColumns(before(Window.partitionBy("conv_id").orderBy("stretch"))).select("conv_id", "stretch", F.col("p").alias("p0"), F.col("q").alias("q0"))
    near = long.withColumns(before(Window.partitionBy("conv_id", "stretch").orderBy("block"))).join(far, ["conv_id", "stretch"], "left")
    near = near.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))) for c in ("p", "q")})
    whole = short.unionByName(near.select(*short.columns))
    return stored(whole.unionByName(turnless.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("block", "length")]).withColumns(begun), allowMissingColumns=True))


def _rollup(rows: DataFrame, measures: str) -> DataFrame:
    """All prefixes of the rows of each block with their measures, and ``level``, how many turns of the block they have."""
    names = ", ".join(TURNS)
    found = rows.sparkSession.sql(f"SELECT block, p, q, {names}, grouping_id() AS rolled, {measures} FROM {{rows}} GROUP BY block, p, q, ROLLUP ({names})", rows=rows)
    level = F.when(F.col("rolled") == 0, WIDTH)
    for i in range(WIDTH):
        level = level.when(F.col("rolled") == (1 << (WIDTH - i)) - 1, i)
    last = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(t)) for i, t in enumerate(TURNS)])
    found = found.withColumn("level", level).withColumn("last", last).where("last IS NOT NULL OR level = 0 AND block = 0").drop("rolled")
    return found.withColumn("depth", F.col("block") * WIDTH + F.col("level"))


def _keys(nodes: DataFrame) -> DataFrame:
    """Nodes with their key (u, v) and that of their parent (pu, pv)."""
    out = {}
    for names, upto in ((("u", "v"), F.col("level")), (("pu", "pv"), F.col("level") - 1)):
        turns = [F.when(upto > i, F.col(t)) for i, t in enumerate(TURNS)]
        for name, start, own in zip(names, ("p", "q"), _hashes(*turns), strict=True):
            out[name] = F.when(upto > 0, F.col(start).bitwiseXOR(own)).otherwise(F.col(start))
    return nodes.withColumns(out)


def _below(nodes: DataFrame) -> DataFrame | None:
    """(block, p, q, leaves, saved, kids) of what hangs below each node where a block other than the first begins; None if none does.

    ``kids`` are the node's own children.  In each round every block hands what it has to the one as many blocks above
    as it has summed, which are then twice as many.
    """
    last = nodes.agg(F.max("block")).first()[0] or 0
    if not last:
        return None
    key = ["block", "p", "q"]
    own = nodes.where("block > 0").groupBy(*key).agg(F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved"), F.count_if(F.col("level") == 1).alias("kids"))
    above = nodes.where(f"level = {WIDTH} AND longest > depth AND block > 0").select((F.col("block") + 1).alias("block"), F.col("u").alias("p"), F.col("v").alias("q"), F.struct(*key).alias("up"))
    rows, reach = stored(own.join(above, key, "left")), 1
    while reach < last:
        given = rows.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        summed = stored(rows.join(given.select("up.*", "more_leaves", "more_saved", "n"), key, "left").na.fill(0, ["more_leaves", "more_saved"]))
        ups = stored(summed.where("n IS NOT NULL").select(F.struct(*key).alias("up"), F.col("up").alias("next"), "n"))
        added = summed.select(*key, (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"), "kids", "up")
        moved = join_counted(added.where("up IS NOT NULL"), ups, "up").select(*key, "leaves", "saved", "kids", F.col("next").alias("up"))
        rows, reach = stored(moved.unionByName(added.where("up IS NULL"))), 2 * reach
    return rows.drop("up")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, u, v, ends_sha256): the digest of the ids of the conversations that end at each node, in order.

    Ids are joined by stretches of their range; one digest is one stream, which a task reads stretch by stretch.
    """
    last = rows.where(F.col("block") == F.expr(f"greatest(0, length - 1) div {WIDTH}"))
    at = {c: F.when(F.col("length") == 0, 0).otherwise(F.col(start).bitwiseXOR(F.col(c))) for c, start in (("u", "p"), ("v", "q"))}
    ids = last.select(F.col("length").alias("depth"), *[x.alias(c) for c, x in at.items()], "conv_id", F.expr(f"conv_id div {TOGETHER}").alias("stretch"))
    texts = ids.groupBy(*NODE, "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, sha256()
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == node:
                    hashed.update(b",")
                elif node:
                    done.append((*node, hashed.hexdigest()))
                if key != node:
                    node, hashed = key, sha256()
                hashed.update(ids.encode())
            yield made(done)
        if node:
            yield made([(*node, hashed.hexdigest())])

    def made(done: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate(kinds)], [*NODE, "ends_sha256"])

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "stretch").select(*NODE, "ids").mapInArrow(digest, "depth long, u long, v long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node of the trie of rebuilt conversations (see :func:`rebuilt`).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, u, v): a node is told apart
    by its depth and smallest member, or by its depth and hashes (u, v).  ``saved_tokens`` sums (members - 1) times the
    UTF-8 bytes of the last text over the node's subtree.

    Turns are in the order of (turn, role, text), nulls first; null roles and texts are empty, and repeated rows are
    turns of their own.  Rows without a conversation id belong to no conversation and are left out.  A conversation
    without rebuilt turns is a member of the root alone.  An empty table has no node; other columns are left out.
    """
    rows = blocks(*rebuilt(placed(turns, conv, turn, role, text)))
    first = _keys(_rollup(rows, "count(*) AS n_convs, min(conv_id) AS conv_id, max(length) AS longest"))
    leaf, saves = (F.col("longest") == F.col("depth")).cast("long"), (F.col("n_convs") - 1) * F.coalesce("last.bytes", F.lit(0))
    nodes = stored(first.withColumns({"leaf": leaf, "saves": saves}).drop("last"))
    below = _below(nodes)
    if below is None:
        nodes = nodes.withColumns({c: F.lit(0).cast("long") for c in ("leaves", "saved", "kids")})
    else:
        at = below.select(((F.col("block") - 1) * WIDTH + WIDTH).alias("depth"), F.col("p").alias("u"), F.col("q").alias("v"), "leaves", "saved", "kids")
        nodes = nodes.join(at, NODE, "left").na.fill(0, ["leaves", "saved", "kids"])
    children = ", ".join(f"count_if(level = {i}) AS c{i}" for i in range(1, WIDTH + 1))
    summed = _rollup(nodes.drop("u", "v"), f"min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(leaf + leaves) AS n_leaves, sum(saves + saved) AS saved_tokens, sum(kids) AS kids, {children}")
    n_children = F.when(F.col("level") == WIDTH, F.col("kids"))
    for i in range(WIDTH):
        n_children = n_children.when(F.col("level") == i, F.col(f"c{i + 1}"))
    whole = stored(_keys(summed).select(*NODE, "pu", "pv", "conv_id", "n_convs", n_children.alias("n_children"), "n_leaves", "saved_tokens"))
    parents = stored(whole.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")))
    named = join_counted(whole.where("depth > 0"), parents, ["depth", "pu", "pv"]).drop("n")
    named = named.unionByName(whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ended = named.join(_ends(rows), NODE, "left")
    return ended.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "u", "v"
    )
