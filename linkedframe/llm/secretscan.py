r"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov models over characters are trained from labelled samples: strings that the fixed patterns mark as
secrets, and the identifiers around them.  A run of identifier characters, with single dots inside it, is a secret if the
logarithm of the likelihood ratio of the two models is high enough for a character and for the whole run.  Every run is
scored, however short and whatever it is made of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import SLICE, with_text_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

#: Documents from which the models are trained.
SAMPLE = 20_000
#: Least log-likelihood ratio of a secret, a character, in nats.
THRESHOLD = 1.0
#: Least log-likelihood ratio of the whole string, which decides on short ones.
WHOLE = 20.0
#: The threshold without a letter or without a digit, as a multiple: words in capitals are rare and look more random than others.
PLAIN = 1.75
#: Characters scored at once; a stretch goes on up to the end of its last run.
STRETCH = 1_000_000

#: Classes of the models: each digit, letter and joining character, and one for all others and both ends.
CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-."
STATES = len(CHARACTERS) + 1
_CODES = np.full(256, len(CHARACTERS), np.int64)
_CODES[[ord(c) for c in CHARACTERS]] = range(len(CHARACTERS))
_DOT, _BREAK = CHARACTERS.index("."), re.compile(r"[^A-Za-z0-9+/_=.-]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, each kind leftmost and without overlaps."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def values_of(text: str, spans: Sequence[tuple[int, int, str]]) -> list[str]:
    """The secret strings themselves."""
    return [ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b] for a, b, kind in spans]


def transitions(value: str) -> np.ndarray:
    """Numbers of the model's transitions along a string."""
    codes = np.concatenate([[STATES - 1], _CODES[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)], [STATES - 1]])
    return codes[:-1] * STATES + codes[1:]


def train(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", smoothing: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each transition, random strings against ordinary identifiers.

    The labelled samples come from about ``sample`` documents, those whose key and text have the smallest hashes: values that the
    patterns mark are random strings, all other runs of letters and digits there are identifiers.  Counts are summed on
    the executors; the driver gets two square tables of fixed size.  Random strings of a uniform source are added, so
    that the models exist for a corpus without any secret.
    """
    n = docs.count()
    chosen = docs if n <= sample else docs.where(F.pmod(F.xxhash64(key, text), F.lit(n)) < sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STATES * STATES), np.int64)
        word = re.compile(r"[A-Za-z0-9+/_=.-]{4,}")
        for batch in batches:
            texts = (x or "" for start in range(0, batch.num_rows, SLICE) for x in batch.column(0).slice(start, SLICE).to_pylist())
            for x in texts:
                spans = base_spans(x)
                for value in values_of(x, spans):
                    np.add.at(counts[0], transitions(value), 1)
                rest, at = [], 0
                for a, b, _ in sorted(spans):
                    rest.append(x[at:a])
                    at = max(at, b)
                rest.append(x[at:])
                values = "\n".join(set(word.findall(" ".join(rest))))
                counts[1] += np.bincount(transitions(values), minlength=STATES * STATES)
        for kind in (0, 1):
            at = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[kind][at], pa.int64())], ["kind", "at", "n"])

    rows = chosen.select(text).mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n")).collect()
    counts = np.zeros((2, STATES * STATES))
    for kind, at, times in rows:
        counts[kind, at] = times
    random = np.random.default_rng(7)
    for alphabet in (CHARACTERS[:62], CHARACTERS[:64], CHARACTERS[:36], CHARACTERS[:10] + "abcdef"):
        for _ in range(200):
            np.add.at(counts[0], transitions("".join(random.choice(list(alphabet), 40))), 1)
    logs = []
    for x in counts.reshape(2, STATES, STATES) + smoothing:
        logs.append(np.log(x / x.sum(axis=1, keepdims=True)))
    return (logs[0] - logs[1]).ravel()


def ratio(value: str, model: np.ndarray) -> float:
    """Log-likelihood ratio of a string, a character."""
    return float(model[transitions(value)].sum()) / len(value)


def runs(codes: np.ndarray, base: Sequence[tuple[int, int]]) -> np.ndarray:
    """Where runs are, as a mask: characters of the models outside the spans of ``base``; of dots, single ones between others."""
    inside = codes < _DOT
    for a, b in base:
        inside[a:b] = False
    dots = codes == _DOT
    for a, b in base:
        dots[a:b] = False
    dots[:1] = dots[-1:] = False
    dots[1:-1] &= inside[:-2] & inside[2:]
    return inside | dots


def markov_spans(text: str, base: Sequence[tuple[int, int, str]], model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Runs, without the spans of ``base`` in them, that look random.  All runs of a stretch of the text are scored together."""
    found, at = [], 0
    while at < len(text):
        end = at + STRETCH
        stop = _BREAK.search(text, end) if end < len(text) else None
        end = stop.end() if stop else len(text)
        codes = _CODES[np.frombuffer(text[at:end].encode("latin-1", "replace"), np.uint8)]
        inside = runs(codes, [(max(a, at) - at, min(b, end) - at) for a, b, _ in base if a < end and b > at])
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        # a run that is too short to reach the least whole ratio, at the model's best step, is none
        enough = (ends - starts + 1) * model.max() >= threshold * WHOLE
        starts, ends = starts[enough], ends[enough]
        if len(starts):
            path = np.full(len(codes) + 2, STATES - 1)
            path[1:-1][inside] = codes[inside]
            digits, letters = (np.append(0, np.cumsum(x)) for x in (codes < 10, (codes >= 10) & (codes < 62)))
            mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
            steps = np.append(model[path[:-1] * STATES + path[1:]], 0.0)
            totals = np.add.reduceat(steps, np.column_stack([starts, ends + 1]).ravel())[::2]
            least = np.maximum(threshold * np.where(mixed, 1.0, PLAIN) * (ends - starts), threshold * WHOLE)
            found += [(at + int(a), at + int(b), "markov") for a, b in zip(starts[totals >= least], ends[totals >= least], strict=True)]
        at = end
    return found


def find_spans(text: str, model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    more = markov_spans(text, base, model, threshold)
    return sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def scan(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``secret_spans``: start, end (code points, exclusive) and kind of each, by start and kind.

    Null and empty texts have none.  Rows are independent: repeated rows repeat, an empty table stays empty, a column of
    this name is replaced, and texts of any length are scanned whole.
    """

    def make():
        return lambda texts: [[[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(x, model, threshold)] for x in texts]]

    return with_text_columns(docs, [("secret_spans", "array<struct<start:int,end:int,kind:string>>")], make, text, keep)


def masked(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``[SECRET]``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join((*out, text[at:]))


def mask(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``[SECRET]``; a null text stays null, other columns as they are."""

    def make():
        return lambda texts: [[masked(x, find_spans(x, model, threshold)) for x in texts]]

    others = [c for c in docs.columns if c != text]  # Python gets each text once and gives back the masked one alone
    rows = with_text_columns(docs.withColumn("__none", docs[text].isNull()), [("__masked", "string")], make, text, [*others, "__none"])
    return rows.select(*[F.when(~rows["__none"], rows["__masked"]).alias(c) if c == text else rows[c] for c in docs.columns])
