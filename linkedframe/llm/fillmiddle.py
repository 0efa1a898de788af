"""Fill-in-the-middle transformation, its cuts found by a learned rank index.

A text's boundaries are the offsets, in code points, behind each of its tokens.  Their index is a function of the rank in
straight pieces that is at most ``ERROR`` code points off, with the residual of each boundary in one byte; pieces are found
by a cone of slopes that narrows while ranks are added.  The offset behind ``k`` tokens is predicted by the piece that
holds rank ``k``, and the stored residual makes it exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import with_text_columns

#: How far a prediction may be off; residuals within it fit a signed byte.
ERROR = 100
#: Code points whose boundaries are found at once, and ranks that a cone takes in at once.
BLOCK, STEP = 1 << 20, 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many stay plain, and how many of the others have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def boundaries(text: str):
    """The offsets behind the tokens of a text, in order, as arrays; a token is a run of A-Z and a-z or another code point."""
    before = False
    for start in range(0, len(text), BLOCK):
        points = np.frombuffer(text[start : start + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points | 32) >= ord("a")) & ((points | 32) <= ord("z"))
        inside = letter & np.concatenate([[before], letter[:-1]])
        before = bool(letter[-1])
        starts = np.flatnonzero(~inside) + start
        yield starts[starts > 0]  # a token ends where the next one starts
    if text:
        yield np.array([len(text)])


@dataclass
class RankIndex:
    """The offset behind each number of tokens: pieces (first rank, first offset, slope) and a residual a rank."""

    ranks: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    slopes: list[float] = field(default_factory=list)
    residuals: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    @classmethod
    def fit(cls, text: str) -> RankIndex:
        index = cls()
        index._add(np.zeros(1, np.int64))
        for found in boundaries(text):
            index._add(found)
        return index

    def _add(self, offsets: np.ndarray) -> None:
        """Adds the boundaries of the next ranks in as few pieces as a cone from each piece's first one allows."""
        at = 0
        while at < len(offsets):
            first, low, high, end = int(offsets[at]), 0.0, np.inf, at + 1
            while end < len(offsets):
                steps = np.arange(end - at, min(end + STEP, len(offsets)) - at)
                rise = offsets[at + steps] - first
                lows = np.maximum(np.maximum.accumulate((rise - ERROR) / steps), low)
                highs = np.minimum(np.minimum.accumulate((rise + ERROR) / steps), high)
                held = len(steps) if lows[-1] <= highs[-1] else int(np.argmax(lows > highs))
                if held:
                    low, high, end = lows[held - 1], highs[held - 1], end + held
                if held < len(steps):
                    break
            slope = (low + high) / 2 if end > at + 1 else 1.0
            self.ranks.append(self.size + at)
            self.offsets.append(first)
            self.slopes.append(float(slope))
            self.residuals.append((offsets[at:end] - self._line(first, slope, np.arange(end - at))).astype(np.int8))
            at = end
        self.size += len(offsets)

    @staticmethod
    def _line(first: int, slope: float, steps):
        return first + np.rint(slope * steps).astype(np.int64)

    @property
    def tokens(self) -> int:
        return self.size - 1

    def offset(self, rank: int) -> int:
        """The offset behind ``rank`` tokens: predicted by its piece, then corrected."""
        piece = int(np.searchsorted(self.ranks, rank, "right")) - 1
        step = rank - self.ranks[piece]
        return int(self._line(self.offsets[piece], self.slopes[piece], np.int64(step))) + int(self.residuals[piece][step])


def draws(seed: int, key: int | None) -> tuple[int, ...]:
    """Four numbers for a document, from the SHA-256 of its id."""
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(text: str, key: int | None, seed: int = 1) -> tuple[int, str, str, int | None, int | None]:
    """(tokens, form, output, prefix_chars, middle_chars) of one text."""
    index = RankIndex.fit(text)
    h1, h2, h3, h4 = draws(seed, key)
    n = index.tokens
    if not text or h3 % 100 >= 100 - PLAIN or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    a, b = (index.offset(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(key, n, form, output, prefix_chars, middle_chars) of each row; cuts follow from its id and ``seed`` alone.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).  Null texts count as empty and stay
    plain, as do texts that hold one of the marks.  A null id counts as an empty one.  Repeated rows have equal results;
    an empty table gives an empty one, and other columns are left out.
    """
    pairs = docs.select(F.col(key).alias("__key"), F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("__keyed"))

    def make():
        def function(keyed: list[str]):
            split = (x.partition(" ") for x in keyed)
            rows = [transform(body, int(name) if name else None, seed) for name, _, body in split]
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return function

    fields = [("n", "long"), ("form", "string"), ("output", "string"), ("prefix_chars", "long"), ("middle_chars", "long")]
    return with_text_columns(pairs, fields, make, "__keyed", ["__key"]).withColumnRenamed("__key", key)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone.

    The marks occur once each, since texts that hold one stay plain and none of them begins within another.
    """
    first = f"if({form} = 'psm', '{SUFFIX}', '{PREFIX}')"
    body = f"substring({output}, {len(PREFIX) + 1})"
    one = f"substring_index({body}, {first}, 1)"
    rest = f"substring({body}, length({one}) + {len(PREFIX) + 1})"
    two = f"substring_index({rest}, '{MIDDLE}', 1)"
    middle = f"substring({rest}, length({two}) + {len(MIDDLE) + 1})"
    return F.expr(f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN concat({one}, {middle}, {two}) ELSE concat({two}, {middle}, {one}) END")
