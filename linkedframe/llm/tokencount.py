"""Token counts by a finite-state tokenizer compiled from the vocabulary of a piece model.

Byte-pair encoding with fixed priorities has two properties that make it finite-state: the encoding of a prefix is a
prefix of the encoding, and a sequence of pieces is the encoding of its text exactly if each two neighbours are.
The last piece of each prefix is therefore known once that prefix is read: it is the only piece ending there that may
follow the last piece of the prefix before it.  A state of the transducer holds what this needs and no more: the
longest suffix that starts some piece, and the last pieces (with relative counts) at the positions inside it.
States and transitions are made when a text first needs them; each transition carries the change in the number of
tokens.  Where no piece spans two neighbouring characters, what stood before has no say, and the state forgets it.

Long texts are cut into chunks, which many tasks read.  A chunk's map leads from entry states to (exit state, tokens).
The states it may be entered in follow from the few characters before it; mostly there is one.  Maps compose
associatively, so a parallel prefix scan of log2(n) rounds gives the state and the count behind each chunk.  Should a text
enter a chunk in a state its map does not have, the map is widened by that state and the scan is run again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import stored, with_text_columns

SPACE = "▁"
#: Characters of a chunk, and of what is known of the text before it.
CHUNK, LOOK = 32_768, 64
UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Transducer:
    """Deterministic transducer from characters to changes of the token count.  ``limit`` bounds its states."""

    def __init__(self, model_path: str, limit: int = 150_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is can be compiled")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only models without user-defined or unused pieces can be compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space after another character")
        chars = {c for p in self.score for c in p}
        if chars - self.score.keys():
            raise ValueError("a character of a piece is no piece")
        self.chars = chars
        self.starts = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self.longest = max(map(len, self.score))
        self.limit = limit
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.contexts: list[tuple] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.root = self.state(("", (None,), (0,)))

    def state(self, context: tuple) -> int:
        """The number of a state: suffix text, last piece at each of its positions, tokens up to there less those up to its end."""
        number = self.states.get(context)
        if number is None:
            number = self.states[context] = len(self.contexts)
            self.contexts.append(context)
            self.arcs.append({})
        return number

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours, best score first."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str | None, right: str) -> bool:
        """Whether ``right`` may stand behind ``left``."""
        if left is None:
            known = self.whole.get(right)
            if known is None:
                known = self.whole[right] = self.merged(right) == [right]
            return known
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * self.limit:
                self.pairs.clear()
            known = self.pairs[left, right] = self.follows(None, right) and self.merged(left + right) == [left, right]
        return known

    def arc(self, number: int, char: str) -> tuple[int, int]:
        """Makes the transition of a state on a character: next state, change of the count."""
        suffix, last, counts = self.contexts[number]
        if char not in self.chars:  # one token for each byte, and nothing crosses it
            found = (self.root, len(char.encode()))
        else:
            text = suffix + char
            for n in range(min(len(text), self.longest), 0, -1):
                piece = text[-n:]
                if piece in self.score and self.follows(last[len(text) - n], piece):
                    change = counts[len(text) - n] + 1
                    break
            else:
                raise AssertionError("no piece fits")
            cut = 0
            while text[cut:] not in self.starts and cut < len(text):
                cut += 1
            before = last[cut:]
            if cut and text[cut - 1 : cut + 1] not in self.inside:
                before = (None, *before[1:])
            found = (self.state((text[cut:], (*before, piece), (*(c - change for c in counts[cut:]), 0))), change)
        self.arcs[number][char] = found
        return found

    def run(self, text: str, state: int) -> tuple[int, int]:
        """The state behind a text that is entered in ``state``, and the change of the count."""
        total, arcs = 0, self.arcs
        for char in text:
            state, change = arcs[state].get(char) or self.arc(state, char)
            total += change
        return state, total

    def count(self, unit: str) -> int:
        """Tokens of a text that starts and ends at boundaries."""
        if len(self.contexts) > self.limit:
            self.reset()
        return self.run(unit, self.root)[1]

    def named(self, number: int) -> str:
        """A state as text, the same in all workers."""
        return json.dumps(self.contexts[number], ensure_ascii=False)

    def numbered(self, name: str) -> int:
        suffix, last, counts = json.loads(name)
        return self.state((suffix, tuple(last), tuple(counts)))

    def entries(self, look: str) -> set[int]:
        """States that a text may be in behind ``look``: one, if no piece spans some two neighbours there."""
        for i in range(len(look) - 1, 0, -1):
            if look[i - 1 : i + 1] not in self.inside:
                return {self.run(look[i:], self.root)[0]}
        return {self.run(look[i:], self.root)[0] for i in range(len(look))}


class Counter(dict):
    """Tokens of texts.  As a dict it keeps the paths of words from boundary to boundary, ``bound`` of them at most."""

    def __init__(self, transducer: Transducer, bound: int = 400_000):
        super().__init__()
        self.transducer, self.bound = transducer, bound

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(SPACE + word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = n
        return n

    def units(self, text: str) -> int:
        """Tokens of a text between boundaries, spaces already written as the model writes them."""
        if text.startswith(SPACE) and SPACE + SPACE not in text:
            return sum(map(self.__getitem__, text[1:].split(SPACE)))
        return sum(self[u[1:]] if u[0] == SPACE and u[1:2] != SPACE else self.transducer.count(u) for u in UNITS.findall(text))

    def marked(self, text: str) -> str:
        """The text as the model reads it."""
        return (SPACE if self.transducer.prefix else "") + text.replace(" ", SPACE) if text else ""

    def chunk_map(self, chunk: str, entries: Iterable[str]) -> list[tuple[str, dict]]:
        """For each entry state the exit state and the tokens of a chunk.

        Behind its first space that follows something else, a chunk has one course whatever state it is entered in.
        """
        t = self.transducer
        if len(t.contexts) > t.limit:
            t.reset()
        first = re.search(f"(?<=[^{SPACE}]){SPACE}", chunk)
        head = chunk if first is None else chunk[: first.start()]
        if first is not None:
            last = max(m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", chunk))
            inner = self.units(chunk[first.start() : last]) if last > first.start() else 0
            end, tail = t.run(chunk[last:], t.root)
        out = []
        for entry in entries:
            state, n = t.run(head, t.numbered(entry))
            out.append((entry, {"exit": t.named(state if first is None else end), "n": n if first is None else n + inner + tail}))
        return out

    def __call__(self, text: str) -> int:
        return self.units(self.marked(text)) if text else 0


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """One for each worker and model."""
    return Counter(Transducer(model_path))


_MAP = "map<string, struct<exit: string, n: bigint>>"
_ARROW_MAP = pa.map_(pa.string(), pa.struct([("exit", pa.string()), ("n", pa.int64())]))


def chunks_of(texts: DataFrame, model_path: str, chunk_chars: int = CHUNK) -> DataFrame:
    """(digest, chunk, look, part) of texts (digest, text): parts of the text as the model reads it, each a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = counter(model_path).marked
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = marked(text)
                for at in range(0, len(text), 64 * chunk_chars):
                    starts = range(at, min(len(text), at + 64 * chunk_chars), chunk_chars)
                    columns = [digest] * len(starts), [i // chunk_chars for i in starts], [text[max(0, i - LOOK) : i] for i in starts], [text[i : i + chunk_chars] for i in starts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["digest", "chunk", "look", "part"])

    return texts.select("digest", "text").mapInArrow(run, "digest string, chunk int, look string, part string").repartition("digest", "chunk")


def maps_of(chunks: DataFrame, model_path: str) -> DataFrame:
    """(digest, chunk, map) of chunks: their maps from the entry states that ``look`` leaves open, or from ``entry`` where chunks have it."""
    asked = "entry" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        t = count.transducer
        for batch in batches:
            maps = []
            for number, look, part, entry in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                names = [entry] if asked else [t.named(i) for i in ({t.root} if number == 0 else t.entries(look))]
                maps.append(count.chunk_map(part, dict.fromkeys(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, _ARROW_MAP)], ["digest", "chunk", "map"])

    entry = F.col("entry") if asked else F.lit(None).cast("string")
    return chunks.select("digest", "chunk", "look", "part", entry.alias("entry")).mapInArrow(run, f"digest string, chunk int, map {_MAP}")


def scan_round(maps: DataFrame, step: int) -> DataFrame:
    """Each map behind that of the chunk ``step`` before it, where there is one."""
    before = maps.select("digest", (F.col("chunk") + step).alias("chunk"), F.col("map").alias("before"))
    both = maps.join(before, ["digest", "chunk"], "left")
    composed = """map_filter(transform_values(before, (k, v) -> named_struct('exit', map[v.exit].exit, 'n', v.n + map[v.exit].n)), (k, v) -> v.exit IS NOT NULL)"""
    return both.select("digest", "chunk", F.expr(f"if(before IS NULL, map, {composed})").alias("map"))


def scanned(maps: DataFrame) -> DataFrame:
    """The compositions of all maps up to each chunk, by a parallel prefix scan."""
    n = (maps.agg(F.max("chunk")).first()[0] or 0) + 1
    step = 1
    while step < n:
        maps = stored(scan_round(maps, step))
        step *= 2
    return maps


def count_long(texts: DataFrame, model_path: str, chunk_chars: int = CHUNK) -> DataFrame:
    """(digest, n_tokens) of texts (digest, text), each counted by many tasks."""
    chunks = chunks_of(texts, model_path, chunk_chars)
    maps = stored(maps_of(chunks, model_path))
    root = F.lit(counter(model_path).transducer.named(0))
    while True:
        prefixes = scanned(maps).select("digest", "chunk", F.try_element_at("map", root).alias("at"))
        ends = stored(prefixes.groupBy("digest").agg(F.max_by("at", "chunk").alias("end"), F.max(F.when(F.col("at").isNotNull(), F.struct("chunk", "at.exit"))).alias("known")))
        lost = stored(ends.where("end IS NULL").select("digest", (F.col("known.chunk") + 1).alias("chunk"), F.col("known.exit").alias("entry")))
        if lost.isEmpty():
            return ends.select("digest", F.col("end.n").alias("n_tokens"))
        more = maps_of(chunks.join(lost, ["digest", "chunk"]), model_path).withColumnRenamed("map", "more")
        maps = stored(maps.join(more, ["digest", "chunk"], "left").select("digest", "chunk", F.expr("if(more IS NULL, map, map_concat(map, more))").alias("map")))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] | None = None, chunk_chars: int = CHUNK) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``.

    Texts of one chunk are counted where they are; longer ones, each distinct one once, by chunks.  Null and empty texts
    have 0 of both.  Rows are independent: repeated rows give repeated results, an empty table an empty one.  Columns of
    these two names are replaced.  A text of any length is counted whole.
    """

    def make():
        count = counter(model_path)
        return lambda texts: ([len(x.encode()) for x in texts], [count(x) for x in texts])

    names = ("n_bytes", "n_tokens")
    long = F.coalesce(F.length(text), F.lit(0)) > chunk_chars
    short = with_text_columns(docs.where(~long), [(n, "long") for n in names], make, text, keep)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.where(long).select(*kept, F.sha2(text, 256).alias("__digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    texts = docs.where(long).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    counted = count_long(texts, model_path, chunk_chars).withColumnRenamed("digest", "__digest")
    return short.unionByName(rows.join(counted, "__digest").select(*kept, *names))
