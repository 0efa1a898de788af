"""Byte-level BPE over a whole corpus with each distinct word encoded once.

1. Each task cuts its documents into chunks of bounded size.  In a chunk the pre-tokens get numbers; a document becomes
   the numbers of its pre-tokens by position.  The chunk's distinct words go, by their hash, into buckets.
2. Words are shuffled by bucket.  Each bucket has all occurrences of its words in any chunk, encodes each distinct word
   once, and sends each chunk the token ids of its words.
3. Documents and ids meet by chunk, and ids are joined to positions.

Only the words of each chunk travel, once each, so a frequent word costs one entry a chunk.  Decoding joins the
token-byte table, which has a fixed size, in the tasks that hold the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a chunk; a single longer text is a chunk of its own.
CHUNK_CHARS = 10_000_000
#: Most values of a column in one batch that is handed to Spark.
OUT_BYTES = 8_000_000
#: Distinct words that a task keeps the ids of.
KNOWN = 2_000_000
#: Bytes of text for each bucket of words, where that gives more buckets than there are shuffle partitions.
BUCKET_BYTES = 200_000_000


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


#: One character of each kind that patterns tell apart; "'s" for contractions.
_PROBES = ("a", "Z", "é", "日", "ǅ", "ʰ", "1", "Ⅷ", "½", "_", "-", ".", "'", "'s", "(", "$", "+", "^", "😀", "\u0301", "\u0903", "\u200d", "\x01")


@lru_cache(maxsize=4)
def space_begins(pattern: str) -> bool:
    """Whether a single space between two characters that are not white space always begins a match of a pattern.

    Tried for each two kinds of characters, which is all that patterns of this sort look at.
    """
    find = regex.compile(pattern).findall
    return all(find(f"{a} {b}") == [*find(a), *find(f" {b}")] for a in _PROBES for b in _PROBES)


class _Words(dict):
    """Numbers of a chunk's pre-tokens.  As a dict: from what stands between two spaces to the numbers of its pre-tokens."""

    def __init__(self, find, by_space: bool):
        super().__init__()
        self.find, self.by_space, self.numbers = find, by_space, {}

    def number(self, words: list[str]) -> list[int]:
        numbers = self.numbers
        return [numbers.setdefault(w, len(numbers)) for w in words]

    def __missing__(self, part: str):
        if not part or part[0].isspace() or part[-1].isspace():
            raise KeyError(part)
        found = self.number(self.find(" " + part))
        if len(part) <= 40:
            self[part] = found
        return found

    def positions(self, text: str) -> np.ndarray:
        """Numbers of the pre-tokens of a text by position.

        Where a space between two characters that are not white space always begins a pre-token, parts between such
        spaces are looked up; a text with any other white space beside a space is cut as a whole.
        """
        if not self.by_space:
            return np.array(self.number(self.find(text)), np.uint32)
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise KeyError(first)
            return np.fromiter(chain(self.number(self.find(first)), chain.from_iterable(map(self.__getitem__, rest))), np.uint32)
        except KeyError:
            return np.array(self.number(self.find(text)), np.uint32)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _words_packed(words: list[bytes]) -> bytes:
    """Words as compressed lengths and bytes, in the order given."""
    return zstandard.compress(b"".join((np.array([len(words), *map(len, words)], "<u4").tobytes(), *words)), 1)


def _words_unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    starts = [4 + 4 * n, *ends.tolist()]
    return [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)]


_CHUNK_ROWS = "chunk string, kind int, bucket int, row long, id string, data binary"


def _cut(pattern: str, chunk_chars: int, buckets: int):
    """Documents to rows of kind 0 (a document: its pre-tokens by position) and 1 (a chunk's words of one bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        by_space = space_begins(pattern)
        task, made, seen = TaskContext.get().partitionId(), 0, 0
        words, size, rows = _Words(find, by_space), 0, []

        def batch(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], _NAMES)

        def closed():
            """Batches of a chunk's rows.  Its name has a digest of its words in their order, so that what is recomputed in
            another order cannot be taken for it."""
            parts: list[tuple[list, list]] = [([], []) for _ in range(buckets)]
            digest = xxhash.xxh3_128()
            for word, number in words.numbers.items():
                raw = word.encode()
                digest.update(len(raw).to_bytes(4, "little") + raw)
                at = parts[xxhash.xxh32_intdigest(raw) % buckets]
                at[0].append(raw)
                at[1].append(number)
            name = f"{task}-{made}-{digest.hexdigest()}"
            packed = ((None, bucket, len(p := _packed(np.diff(np.array(numbers, np.int64), prepend=0))).to_bytes(4, "little") + p + _words_packed(raw)) for bucket, (raw, numbers) in enumerate(parts) if raw)
            out, held = [], 0
            for row in chain(((name, 0, None, *x) for x in rows), ((name, 1, bucket, None, None, data) for _, bucket, data in packed)):
                out.append(row)
                held += len(row[-1])
                if held > OUT_BYTES:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    if size and size + len(text) > chunk_chars:
                        yield from closed()
                        words, size, rows, made = _Words(find, by_space), 0, [], made + 1
                    rows.append((seen, key, _packed(words.positions(text))))
                    size, seen = size + len(text), seen + 1
        if rows:
            yield from closed()

    return run


_NAMES = ["chunk", "kind", "bucket", "row", "id", "data"]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()]


def _encode_words(path: str, pattern: str):
    """Chunks' words to their ids, row by row.  All rows of a bucket come to one task, which encodes a distinct word once;
    it forgets the words when it knows ``KNOWN`` of them, so its memory does not grow with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoding(path, pattern).encode_single_token, {}
        whole = encoding(path, pattern).encode_ordinary
        for batch in batches:
            out = []
            for raw in batch.column(batch.schema.get_field_index("data")).to_pylist():
                cut = 4 + int.from_bytes(raw[:4], "little")
                ids = []
                for word in _words_unpacked(raw[cut:]):
                    found = known.get(word)
                    if found is None:
                        try:
                            found = [encode(word)]
                        except KeyError:
                            found = whole(word.decode())
                        if len(known) >= KNOWN:
                            known.clear()
                        known[word] = found
                    ids.append(found)
                packed = (_packed(np.array([len(x) for x in ids], np.uint32)), _packed(np.fromiter(chain.from_iterable(ids), np.uint32)))
                out.append(raw[:cut] + len(packed[0]).to_bytes(4, "little") + b"".join(packed))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(out, pa.binary())], _NAMES)

    return run


def _join_positions(chunk: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk's documents and the ids of its words: the ids of each document."""
    numbers, sizes, ids = [], [], []
    for part in words.column("data"):
        raw = part.as_py()
        at = 4 + int.from_bytes(raw[:4], "little")
        cut = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        numbers.append(np.cumsum(_unpacked(raw[4:at])))  # they ascend, so their steps were packed
        sizes.append(_unpacked(raw[at + 4 : cut]))
        ids.append(_unpacked(raw[cut:]))
    n_words = sum(map(len, numbers))
    lengths = np.zeros(n_words, np.int32)
    starts = np.zeros_like(lengths)
    flat, at = (np.concatenate(ids) if ids else np.zeros(0, np.uint32)).astype(np.int32), 0
    for n, s, i in zip(numbers, sizes, ids, strict=True):
        lengths[n] = s
        starts[n] = at + np.cumsum(s) - s
        at += len(i)
    found = []
    docs = chunk.filter(pc.equal(chunk.column("kind"), 0))
    for data in docs.column("data"):
        positions = _unpacked(data.as_py())
        if len(positions) and positions.max() >= n_words:
            raise RuntimeError("a chunk was computed again in another order; store the input as a table first")
        n = lengths[positions]
        ends = np.cumsum(n)
        found.append(flat[np.repeat(starts[positions] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    values = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.table([docs.column("row"), docs.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], ["row", "id", "ids"])


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pc.equal(batch.column("kind"), 1))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, buckets: int | None = None) -> DataFrame:
    """(key, ids) of each row of ``docs``: token ids by the ranks at ``path``, each match of ``pattern`` for itself.

    A null or empty text has no ids.  Keys are only carried: null, repeated and tied ones are kept, one row out for each
    row in, and an empty table gives an empty one.  Other columns are left out.  A text of any length is encoded whole;
    one longer than a chunk makes a chunk of its own.  ``buckets`` grow with the input (default: at least the shuffle
    partitions).  Should an executor be lost and its part of ``docs`` come again in another order, the job fails rather
    than mix chunks; tables and files come in the same order.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    kind = docs.schema[key].dataType
    source = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    # one exchange of the chunks serves both uses; the words are picked by a function, since Spark would move a filter
    # below the exchange and then cut all documents twice
    chunks = source.mapInArrow(_cut(pattern, chunk_chars, buckets), _CHUNK_ROWS).repartition("chunk")
    words = chunks.mapInArrow(_words_only, _CHUNK_ROWS).repartition(buckets, "bucket").mapInArrow(_encode_words(path, pattern), _CHUNK_ROWS)
    joined = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_join_positions, "row long, id string, ids array<int>")
    return joined.select(F.col("id").cast(kind).alias(key), "ids")


class Pieces:
    """A table of byte strings whose rows are joined by number."""

    #: Numbers that are joined at once.
    PART = 300_000

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.lengths = np.array([len(x) for x in rows], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths

    def join(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined bytes, and where each row ends."""
        out = []
        for i in range(0, len(numbers), self.PART):
            part = numbers[i : i + self.PART]
            n = self.lengths[part]
            ends = np.cumsum(n, dtype=np.int32)
            out.append(self.flat[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1], dtype=np.int32)].tobytes())
        return b"".join(out), np.cumsum(self.lengths[numbers], dtype=np.int64)

    def of_lists(self, lists: pa.ListArray) -> list[bytes]:
        """The joined bytes of each list."""
        offsets = lists.offsets.to_numpy()
        joined, ends = self.join(lists.values.to_numpy()[offsets[0] : offsets[-1]])
        cuts = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def token_pieces(path: str) -> Pieces:
    """The token-byte table, for joining."""
    return Pieces(token_bytes(path))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of each row's ids from the token-byte table.  Null ids give null."""
    schema = encoded.select("*").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column(ids)
                values = [None if null else x for x, null in zip(token_pieces(path).of_lists(lists), lists.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
