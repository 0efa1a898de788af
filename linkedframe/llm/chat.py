r"""Chat formatting as relational work: turns collected, sorted, merged by role and joined to one string.

The template writes a block ``<s>role[INST]text</s>`` for each run of turns of one role, the run's texts parted by
``[SEP]``.  Inside roles and texts ``\``, ``<`` and ``[`` are written ``\b``, ``\l`` and ``\q``; no control string can
then occur there, and reading back is exact.  ``loss_spans`` has the code points of each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, PART, CLOSE = "<s>", "[INST]", "[SEP]", "</s>"
#: Turns of a conversation that are collected together before its segments are.
SEGMENT = 64


def escape(column: Column) -> Column:
    for plain, written in (("\\", "\\b"), ("<", "\\l"), ("[", "\\q")):
        column = F.replace(column, F.lit(plain), F.lit(written))
    return column


def unescape(column: Column) -> Column:
    for plain, written in (("[", "\\q"), ("<", "\\l"), ("\\", "\\b")):
        column = F.replace(column, F.lit(written), F.lit(plain))
    return column


def starts_of(lengths: str, block: int = 64) -> str:
    """SQL for where each of a row of texts starts, given a column with their lengths.

    Sums go by blocks of blocks, since appending to one array copies it each time.
    """
    blocks = f"sequence(0, cast((size({lengths}) - 1) div {block} as int))"
    part = f"slice({lengths}, b * {block} + 1, {block})"
    none = "cast(array() as array<bigint>)"

    def running(values: str, start: str, name: str) -> str:
        return f"""aggregate({values}, named_struct('at', {start}, 'out', {none}),
            ({name}, x) -> named_struct('at', {name}.at + x, 'out', concat({name}.out, array({name}.at))), {name} -> {name}.out)"""

    sums = f"transform({blocks}, b -> aggregate({part}, 0L, (s, x) -> s + x))"
    return f"flatten(zip_with({blocks}, {running(sums, '0L', 'u')}, (b, o) -> {running(part, 'o', 'v')}))"


# Turns of a segment, in order: what stands before each text (nothing before the first, whose block or part is opened by
# the conversation) and the text.
_PIECES = f"""
transform(turns, (t, i) -> named_struct(
  'lead', if(i = 0, '', if(turns[i - 1].role = t.role, '{PART}', concat('{CLOSE}{OPEN}', t.role, '{MIDDLE}'))), 'text', t.text, 'loss', t.role = 'assistant'))
"""

# What opens each segment of a conversation: a block, or a text of the block that the segment before left open.
_LEADS = f"""
transform(segments, (s, i) -> if(i > 0 and segments[i - 1].last = s.first, '{PART}', concat(if(i > 0, '{CLOSE}', ''), '{OPEN}', s.first, '{MIDDLE}')))
"""


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row a conversation: conv_id, formatted, loss_spans.

    Turns are in order of (turn, role, text), nulls first; repeated rows are turns of their own.  A null role or text
    is empty.  Null conversation ids form one conversation.  Other columns are left out; an empty table gives no rows.
    Turns are first collected in segments of ``SEGMENT`` turn numbers, so that long conversations are sorted and merged
    in pieces by many tasks.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.transform(F.array_sort(F.collect_list("row")), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    spans = """transform(filter(arrays_zip(pieces, starts), x -> x.pieces.loss),
        x -> named_struct('start', x.starts + length(x.pieces.lead), 'end', x.starts + length(x.pieces.lead) + length(x.pieces.text)))"""
    segments = (
        turns.select("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment"), row.alias("row"))
        .groupBy("conv_id", "segment")
        .agg(sorted_turns.alias("turns"))
        .select("conv_id", "segment", F.expr("turns[0].role").alias("first"), F.element_at("turns", -1)["role"].alias("last"), F.expr(_PIECES).alias("pieces"))
        .withColumn("lengths", F.expr("transform(pieces, x -> cast(length(x.lead) + length(x.text) as bigint))"))
        .withColumn("starts", F.expr(starts_of("lengths")))
        .withColumn("body", F.expr("array_join(transform(pieces, x -> concat(x.lead, x.text)), '')"))
        .select("conv_id", F.struct("segment", "first", "last", "body", F.length("body").cast("long").alias("size"), F.expr(spans).alias("spans")).alias("row"))
    )
    return (
        segments.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("segments"))
        .withColumn("leads", F.expr(_LEADS))
        .withColumn("lengths", F.expr("zip_with(segments, leads, (s, l) -> s.size + length(l))"))
        .withColumn("starts", F.expr(starts_of("lengths")))
        .select(
            "conv_id",
            F.concat(F.array_join(F.expr("transform(segments, (s, i) -> concat(leads[i], s.body))"), ""), F.lit(CLOSE)).alias("formatted"),
            F.expr("flatten(transform(segments, (s, i) -> transform(s.spans, x -> named_struct('start', x.start + starts[i] + length(leads[i]), 'end', x.end + starts[i] + length(leads[i])))))").alias("loss_spans"),
        )
    )


#: Code points of the stretches that formatted texts are cut into before spans are taken from them.
STRETCH = 4096


def read_chats(formatted: DataFrame) -> DataFrame:
    """Formatted rows with ``turns`` (role and text of each, in order) and ``loss_text`` (all text under the mask, unescaped)."""
    blocks = F.split(F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN + CLOSE)})"), CLOSE + OPEN, -1)
    texts = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring_index(b, MIDDLE, -1), r"\[SEP]", -1),
            lambda t: F.struct(unescape(F.substring_index(b, MIDDLE, 1)).alias("role"), unescape(t).alias("text")),
        ),
    )
    # a span is taken from the stretches it lies in, since a substring is found by counting from the start of its text
    cut = formatted.withColumn("__stretches", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)))
    first, last = f"(s.start div {STRETCH})", f"(greatest(s.start, s.end - 1) div {STRETCH})"
    loss = f"""transform(loss_spans, s -> substring(array_join(slice(__stretches, cast({first} + 1 as int), cast({last} - {first} + 1 as int)), ''),
        cast(s.start - {first} * {STRETCH} + 1 as int), cast(s.end - s.start as int)))"""
    return cut.select(*formatted.columns, F.flatten(texts).alias("turns"), unescape(F.array_join(F.expr(loss), "")).alias("loss_text"))
