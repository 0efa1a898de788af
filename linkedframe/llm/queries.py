"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkedframe.llm import bpe, chat, decontaminate, fillmiddle, langid, mpegts, neighbours, secretscan, sharding, simhash, tokencount, toxicity, trie
from linkedframe.llm.common import bucket_of, read_table

TOXIC = 0.7
GOOD = 0.5
TOKEN_LIMIT = 4096


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Grammar:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").where(bucket_of("doc_id", 3) != 1)
    return toxicity.train(read_table(spark, sf_dir, "documents", "doc_id", "text"), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), keep=["doc_id"])
    held_out = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = secretscan.scan(docs, secretscan.train(docs), keep=["doc_id"])
    kinds = {k: F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{k}')) as bigint)") for k in secretscan.KINDS}

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[kinds[k].alias(f"n_{k}") for k in secretscan.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("secret_spans").alias("spans"),
    )


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpegts.store_texts(read_table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    read = mpegts.read_media(stored, keep=["doc_id", "n_bytes", "media"])
    read = read.withColumn("stream", F.expr("streams[0]")).withColumn("payload", F.col("stream.payload"))
    tail = F.expr("substring(payload, -64, 64)")
    feature = F.format_string(
        "packets=%d;programs=%d;streams=%d;units=%d;last_pts=%d;access=%d;continuity=%d;tables=%d;sync=%d",
        "n_packets", "n_programs", "n_streams", F.size("stream.pts"), F.element_at("stream.pts", -1), F.size("stream.access"), "continuity_errors", "table_errors", "sync_errors",
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(bucket_of("doc_id", 4) != 2))
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    return langid.identify(docs.drop("lang"), model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents", "doc_id"), "doc_id")


#: The largest steps of a shard in its preference order come from the same digest as its offset.
OP6_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%02d', i) AS shard, md5(printf('shard-%02d', i)) AS d FROM range({len(sharding.SHARDS)}) t(i)
), steps AS (
  SELECT list(('0x' || substr(d, 1, 15))::BIGINT % {sharding.SLOTS} ORDER BY i) AS place,
         list(('0x' || substr(d, 16, 15))::BIGINT % {sharding.SLOTS - 1} + 1 ORDER BY i) AS step FROM shards
), turns AS (
  SELECT 0 AS turn, list_transform(range({sharding.SLOTS}), lambda x: -1) AS owner, NULL::BIGINT AS slot FROM steps
  UNION ALL
  SELECT turn + 1, list_concat(owner[:claim], [turn % {len(sharding.SHARDS)}], owner[claim + 2:]), claim
  FROM (SELECT turn, owner,
          list_filter(list_transform(range({sharding.SLOTS}), lambda j: (place[turn % {len(sharding.SHARDS)} + 1] + j * step[turn % {len(sharding.SHARDS)} + 1]) % {sharding.SLOTS}),
                      lambda s: owner[s + 1] = -1)[1] AS claim
        FROM turns, steps WHERE turn < {sharding.SLOTS})
), filled AS (
  SELECT slot, printf('shard-%02d', (turn - 1) % {len(sharding.SHARDS)}) AS shard FROM turns WHERE turn > 0
)
SELECT d.doc_id, f.slot, f.shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents
) d JOIN filled f ON f.slot = d.slot
"""

PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    read = chat.read_chats(chat.format_chats(turns.unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(text) * 4 - length(replace(text, chr(92), '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) AS text_chars,
    length(role) * 4 - length(replace(role, chr(92), '')) - length(replace(role, '<', '')) - length(replace(role, '[', '')) AS role_chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN before = role THEN 5 ELSE 3 + role_chars + 6 + 4 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        decoder = bpe.token_pieces(path)
        printer = bpe.Pieces([b"%d " % i for i in range(len(decoder.lengths))])
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column(1)
                ids = [sha256(x[:-1]).hexdigest() for x in printer.of_lists(lists)]
                decoded = [sha256(x).hexdigest() for x in decoder.of_lists(lists)]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists.value_lengths().cast(pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.col("n_near").alias("n_near_items"))


def _sql_words(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_sql_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 12], ' ') AS s, least(len(w), 13) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN win USING (s)),
counted AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
counts AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
lists AS (SELECT DISTINCT item, w[i : i + 12] AS t FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
rare AS (
  SELECT item, t, first(l.word ORDER BY coalesce(c, 0), q) AS word FROM (SELECT item, t, unnest(t) AS word, generate_subscripts(t, 1) AS q FROM lists) l
  LEFT JOIN counts USING (word) GROUP BY item, t HAVING min(coalesce(c, 0)) > 0
),
near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d) x JOIN rare USING (word) JOIN d USING (doc_id)
  WHERE list_has_all(w[greatest(1, place - {decontaminate.DISTANCE}) : place + {decontaminate.DISTANCE}], t) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fillmiddle.fill_in_middle(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fillmiddle.restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(t) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '{fillmiddle.PREFIX}') OR contains(x, '{fillmiddle.SUFFIX}') OR contains(x, '{fillmiddle.MIDDLE}') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(t[1 : a], '') AS pre, array_to_string(t[a + 1 : b], '') AS mid, array_to_string(t[b + 1 :], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).drop("u", "v")


#: Nodes as paths of digests; a node's subtree is found from all paths that begin with its own.
OP12_SQL = f"""
WITH o AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(struct_pack(id, bytes) ORDER BY pos) AS own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) % {trie.HEADS} AS h FROM o GROUP BY conv_id
), w AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1 : c.h], c.own[c.h + 1 :]) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % {trie.GROUP}
), m AS (
  SELECT conv_id, len(turns) AS size, d AS depth, array_to_string([x.id FOR x IN turns[1 : d]], '') AS path, turns[d].bytes AS bytes FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM w)
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(bytes), 0) * (count(*) - 1) AS saves, max(size) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY path, depth
), s AS (
  SELECT left(path, 32 * d) AS path, count_if(depth = d + 1) AS n_children, count_if(leaf) AS n_leaves, sum(saves) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN n p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1)) AND p.depth = n.depth - 1
"""


def quality_voters(spark: SparkSession, sf_dir: str) -> neighbours.Voters:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality").where(bucket_of("doc_id", 3) != 1)
    return neighbours.train(read_table(spark, sf_dir, "documents", "doc_id", "text"), labels)


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    scored = neighbours.vote(docs, quality_voters(spark, sf_dir), keep=["doc_id"])
    held_out = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_transport_stream": op3_transport_stream,
    "op4_token_count": op4_token_count,
    "op5_language": op5_language,
    "op6_sharding": op6_sharding,
    "op7_chat_format": op7_chat_format,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_middle": op11_fill_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_votes": op13_quality_votes,
}
ORACLES = {"op6_sharding": OP6_SQL, "op7_chat_format": OP7_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_prefix_trie": OP12_SQL}
