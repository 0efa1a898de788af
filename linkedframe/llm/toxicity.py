"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as symbols, one for each word or mark.  The lexicon, a weighted transducer from words to symbols, knows
insults and threats (whole words or stems, each arc with a weight), those spoken to or of, negations and verbs of saying.
Contractions are read in parts: ``you're`` has the target ``you``, ``didn't`` and ``n'est`` a negation.  Verbs of saying are
known in all forms that their endings make.  Four small transducers rewrite the symbols and are composed into one machine:

* quotation: what stands inside quotation marks is reported; a line's end closes them;
* reported speech: what follows a verb of saying is reported, over commas and colons, up to the sentence's end;
* negation: insults and threats within a few words behind a negation are negated, articles and the like not counted;
* target: the end of a clause tells whether somebody was addressed or spoken of in it.

A clause adds its insults' and threats' weights under the kind it ends as (plain, targeted, threat, negated, reported);
words outside matched clauses count for nothing.  The arcs' weights and the weight of each kind are trained from labelled
documents; built-in arcs serve where the labels know nothing.  A trained word is a threat if at least half of the toxic
documents that have it announce it to somebody (``will … you``), else an insult.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import bounded_sample, stored, with_text_columns


def forms(verbs: str, endings: Sequence[str]) -> frozenset[str]:
    """Verbs with each ending; an e at the end gives way to an ending that begins with a vowel."""
    return frozenset(v[:-1] + e if v.endswith("e") and e[:1] in tuple("aeiou") else v + e for v in verbs.split() for e in endings)


#: Built-in arcs; training adds to them and weighs the threats.
INSULTS = ("idiot", "moron", "scum", "loser", "trash", "pathetic", "worthless", "stupid", "clown", "disgusting", "imbecile", "bastard")
THREATS = ("kill", "hurt", "destroy", "strangle", "stab", "shoot", "murder", "töten", "umbringen", "ermorden", "tuer", "assassiner", "matar", "asesinar")
TARGETS = frozenset("you your yours they them their he him his she her those people du dich dir ihr euch sie tu te t' toi vous il elle ils elles usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no nobody cannot nicht kein keine keinen nie ne n' pas jamais nunca jamás".split())
REPORTS = (
    forms("say call tell claim quote shout yell scream write answer insist allege repeat", ("", "s", "d", "ed", "ing"))
    | forms("sag nenn behaupt schreib ruf", ("e", "t", "te", "en", "ten", "end"))
    | frozenset("said told wrote written schrieb schrieben nannte nannten rief riefen".split())
    | frozenset("dit disent disait écrit appelle appelé crie crié dijo dice dicen diciendo escribió llama llamó gritó".split())
)
#: Words that do not use up a negation's reach.
SMALL = frozenset("a an the such so very ein eine einen der die das den un une le la les el los las una".split())
#: Words that announce what somebody will do.
INTENTS = "will|shall|gonna|gotta|going to|werde|werden|wird|vais|va|allons|voy a|va a|vamos a"
INSULT_WEIGHT, THREAT_WEIGHT = 3.0, 2.0
NEGATION_REACH = 3

#: Labelled documents of each class that are used for training, at most.
SAMPLE = 10_000
#: Least log-odds of a trained arc, at its lower confidence bound, and lengths of stems.  The bound alone decides on arcs.
LEAST, STEMS = 2.0, range(4, 9)
#: Distinct words and stems that a training task holds before it hands their counts on.
HELD = 1_000_000

#: Words end at an apostrophe; ``n't`` stays with what it denies, and ``n'`` and ``t'`` before a word keep theirs.
_TOKENS = re.compile(r"[^\W_]+n['’]t(?![^\W_])|(?<![^\W_])[nt]['’](?=[^\W_])|[^\W_]+|[\"“”„«»]|[.!?]+|[;:,]|\n")
#: The words behind an announcement, as far as a threat and whom it is meant for stand apart.
_ANNOUNCED = re.compile(rf"(?:(?<![^\W_])(?:{INTENTS})|['’]ll)(?=((?:\s+[^\W\d_]+){{2,6}}))")
_MARKS = {'"': "quote", "“": "open", "„": "open", "«": "open", "”": "close", "»": "close", "\n": "line", ";": "break", ":": "break", ",": "break"}
#: Kinds of clause weights, then the strongest clause of those neither negated nor reported.
KINDS = ("plain", "targeted", "threat", "negated", "reported", "most")


@dataclass(frozen=True)
class Transducer:
    """Arcs from (state, symbol read) to (next state, symbol written); without an arc a symbol passes and the state stays."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, str]]

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: Sequence[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out


def compose(first: Transducer, second: Transducer, alphabet: Sequence[str]) -> Transducer:
    """The transducer that writes what ``second`` writes on reading what ``first`` writes; states are the reachable pairs."""
    start = (first.start, second.start)
    arcs, seen, waiting = {}, {start}, [start]
    while waiting:
        a, b = waiting.pop()
        for symbol in alphabet:
            to_a, between = first.step(a, symbol)
            to_b, written = second.step(b, between)
            arcs[(a, b), symbol] = (to_a, to_b), written
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                waiting.append((to_a, to_b))
    return Transducer(start, arcs)


#: What the lexicon writes.
ALPHABET = ("other", "small", "insult", "threat", "target", "negation", "report", "quote", "open", "close", "break", "stop", "line")
_HITS = ("insult", "threat")

_REPORTED = {("in", hit): ("in", "reported") for hit in _HITS}
QUOTATION = Transducer(
    "out",
    {("out", "quote"): ("in", "mark"), ("out", "open"): ("in", "mark"), ("in", "quote"): ("out", "mark"), ("in", "close"): ("out", "mark"), ("in", "line"): ("out", "line"), **_REPORTED},
)
REPORTED = Transducer("out", {("out", "report"): ("in", "other"), ("in", "stop"): ("out", "stop"), ("in", "line"): ("out", "line"), **_REPORTED})
NEGATION = Transducer(
    0,
    {
        **{(n, "negation"): (NEGATION_REACH, "other") for n in range(NEGATION_REACH + 1)},
        **{(n, end): (0, end) for n in range(1, NEGATION_REACH + 1) for end in ("break", "stop", "line")},
        **{(n, hit): (n - 1, "negated") for n in range(1, NEGATION_REACH + 1) for hit in _HITS},
        **{(n, x): (n - 1, x) for n in range(1, NEGATION_REACH + 1) for x in ("other", "target", "report", "reported")},
    },
)
TARGET = Transducer(
    "none",
    {
        ("none", "target"): ("some", "other"),
        **{("none", end): ("none", "end") for end in ("break", "stop", "line")},
        **{("some", end): ("none", "targeted end") for end in ("break", "stop", "line")},
    },
)


def grammar_machine() -> Transducer:
    """All four transducers as one."""
    machine = QUOTATION
    for other in (REPORTED, NEGATION, TARGET):
        machine = compose(machine, other, ALPHABET)
    return machine


@dataclass(frozen=True)
class Grammar:
    """Arcs of the lexicon (insults by word or stem, threats by word), the weight of each kind of clause, and the bias."""

    words: dict[str, float]
    stems: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, THREAT_WEIGHT))
    kinds: tuple[float, ...] = (1.0, 1.2, 1.0, 0.2, 0.4, 1.0)
    bias: float = -3.0


BUILT_IN = Grammar(dict.fromkeys(INSULTS, INSULT_WEIGHT), {})


class Machine:
    """A grammar's lexicon before the composed transducers."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar = grammar
        self.hits = ahocorasick.Automaton()
        for word in {*grammar.words, *grammar.stems, *grammar.threats}:
            self.hits.add_word(word, word)
        self.hits.make_automaton()
        self.lengths = sorted({len(s) for s in grammar.stems}, reverse=True)
        composed = grammar_machine()
        self.start, self.arcs = composed.start, composed.arcs

    def read(self, word: str) -> tuple[str, float]:
        """The lexicon: the symbol and the weight that a word writes; an insult by its own arc, else by its longest stem."""
        g = self.grammar
        if word in _MARKS:
            return _MARKS[word], 0.0
        if word[0] in ".!?":
            return "stop", 0.0
        word = word.replace("’", "'")
        if word in g.threats:
            return "threat", g.threats[word]
        if word.endswith("n't"):
            return "negation", 0.0
        for name, words in (("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("small", SMALL)):
            if word in words:
                return name, 0.0
        weight = g.words.get(word)
        if weight is None:
            weight = next((w for n in self.lengths if (w := g.stems.get(word[:n])) is not None), None)
        return ("other", 0.0) if weight is None else ("insult", weight)

    def clauses(self, text: str) -> Iterator[list[float]]:
        """The weights of each matched clause of some lines by kind."""
        state, held, arcs = self.start, dict.fromkeys(("insult", "threat", "negated", "reported"), 0.0), self.arcs
        for word in [*_TOKENS.findall(text), "\n"]:
            symbol, weight = self.read(word)
            state, written = arcs[state, symbol]
            if written in held:
                held[written] += weight
            elif written.endswith("end") and any(held.values()):
                targeted = written != "end"
                yield [0.0 if targeted else held["insult"], held["insult"] if targeted else 0.0, held["threat"] if targeted else 0.0, held["negated"], held["reported"]]
                held = dict.fromkeys(held, 0.0)

    def features(self, text: str) -> list[float]:
        """Clause weights of a text by kind (as logarithms, so that long texts do not win by length) and the largest.

        Lines without a match of any arc are not read further; others are read whole.
        """
        text = text.lower()
        out, most, done = [0.0] * (len(KINDS) - 1), 0.0, 0
        for end, word in self.hits.iter(text):
            start = end + 1 - len(word)
            if start < done or start and text[start - 1].isalnum():
                continue
            if word not in self.grammar.stems and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            begin, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
            done = len(text) if stop < 0 else stop
            for weights in self.clauses(text[begin:done]):
                out = [a + b for a, b in zip(out, weights, strict=True)]
                most = max(most, sum(weights[:3]))
        return [*(math.log1p(x) for x in out), most]

    def score(self, text: str) -> float:
        z = self.grammar.bias + sum(w * x for w, x in zip(self.grammar.kinds, self.features(text), strict=True))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def announced(text: str) -> set[str]:
    """Words of a text in small letters that stand up to three words behind an announcement and by one that is spoken to or of."""
    found = set()
    for behind in _ANNOUNCED.findall(text):
        words = behind.split()
        found |= {w for i, w in enumerate(words[:3]) if w not in TARGETS and not TARGETS.isdisjoint(words[max(0, i - 2) : i + 3])}
    return found


def _with_stems(words: set[str]) -> set[str]:
    return {*words, *(f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n)}


#: Counts of an arc: other and toxic documents of half 0, those of half 1, and toxic documents of each that announce it.
_COUNTS = ("b0", "a0", "b1", "a1", "t0", "t1")


def _arc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of each half each word and stem occurs, and is announced."""
    counts: tuple[Counter, ...] = tuple(Counter() for _ in _COUNTS)

    def handed() -> Iterator[pa.RecordBatch]:
        names = list(set().union(*counts))
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[n] for n in part], pa.int64()) for c in counts)], ["arc", *_COUNTS])
        for c in counts:
            c.clear()

    for batch in batches:
        for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = (text or "").lower()
            words = {w for w in re.findall(r"[^\W\d_]+", text) if len(w) > 2}
            counts[2 * half + toxic].update(_with_stems(words))
            if toxic:
                counts[4 + half].update(_with_stems(announced(text) & words))
            if sum(map(len, counts)) > HELD:
                yield from handed()
    yield from handed()


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression (last column of x: 1, and no other weight below 0) pulled towards ``prior``.

    A weight that stands at 0 and would fall further takes no part in a step.
    """

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        free = np.flatnonzero((w > 0) | (slope < 0) | (np.arange(len(w)) == len(w) - 1))
        bend = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + ridge * np.eye(len(free))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(bend, slope[free])
        size = 1.0
        while size > 1e-6:
            new = w - size * step
            new[:-1] = np.maximum(new[:-1], 0)
            if loss(new) < loss(w):
                break
            size /= 2
        else:
            break
        w = new
    return w


def _choose(rows) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems from candidates (arc, documents, log-odds): the most useful first, then whole words and long stems.

    A stem is left out if a chosen word or longer stem covers nearly all its documents, and what a chosen stem covers is
    left out if it says little more.
    """
    words, stems = dict.fromkeys(INSULTS, INSULT_WEIGHT), {}
    covered: dict[str, int] = {}
    for arc, n, odds in sorted(rows, key=lambda r: (-r[1] * min(6.0, r[2]), r[0].endswith("*"), -len(r[0]), r[0])):
        name, is_stem, weight = arc.rstrip("*"), arc.endswith("*"), min(6.0, odds)
        if is_stem and covered.get(name, 0) >= 0.9 * n:
            continue
        if any(stems.get(name[:k], 0) >= weight - 1.0 for k in STEMS if k < len(name) or not is_stem):
            continue
        (stems if is_stem else words)[name] = weight
        for k in STEMS:
            covered[name[:k]] = max(n, covered.get(name[:k], 0))
    return words, stems


def _grammar(rows: list, halves: Sequence[int], sizes: dict) -> Grammar:
    """The lexicon from the counts of some halves.  A stem of announced words is left out, since its words are threats."""
    n0, n1 = (sum(sizes.get((toxic, h), 0) for h in halves) for toxic in (0, 1))
    chosen, threats = [], dict.fromkeys(THREATS, THREAT_WEIGHT)
    for arc, *counts in rows:
        b, a = (sum(counts[2 * h + toxic] for h in halves) for toxic in (0, 1))
        told = sum(counts[4 + h] for h in halves)
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if arc in threats:
            if a + b >= 3:
                threats[arc] = min(6.0, max(0.0, odds))
        elif a >= 3 and odds - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= LEAST:
            if 2 * told < a:
                chosen.append((arc, a, odds))
            elif not arc.endswith("*"):
                threats[arc] = min(6.0, odds)
    return Grammar(*_choose(chosen), threats)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """A grammar from documents whose keys have labels 0 or 1; at most ``sample`` documents of each class are used.

    The documents taken are those whose keys have the smallest hashes; of texts of one key, and of near-copies, the one
    that sorts first.  Arcs are words and stems whose log-odds are high even at their lower confidence bound, counted on
    the executors and filtered before they reach the driver; a threat seen in three documents gets its log-odds as
    weight.  The weights of the kinds of clauses are fitted with each half of the documents read by the arcs of the other.
    Null labels are left out, a key with both labels is toxic, and without labels the built-in grammar is returned.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    chosen = bounded_sample(known, key, "toxic", sample)
    found = docs.select(key, text).join(F.broadcast(chosen), key)  # two samples of keys at most
    # of near-copies, which share the least hash of their word triples, one counts
    least = "array_min(transform(sequence(0, greatest(0, size(words) - 3)), i -> xxhash64(slice(words, i + 1, 3))))"
    copies = found.select(key, text, "toxic", F.split(F.coalesce(text, F.lit("")), r"\s+").alias("words")).withColumn("least", F.expr(least))
    one = copies.groupBy("toxic", "least").agg(F.min(F.struct(key, text)).alias("d"))
    texts = stored(one.select("toxic", "d.*").withColumn("half", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)).cast("int")))
    sizes = {(r["toxic"], r["half"]): r["n"] for r in texts.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    if not all(any(sizes.get((toxic, h)) for h in (0, 1)) for toxic in (0, 1)):
        return BUILT_IN
    schema = ", ".join(["arc string", *(f"{c} long" for c in _COUNTS)])
    counted = texts.select(text, "toxic", "half").mapInArrow(_arc_counts, schema).groupBy("arc").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    # what could be chosen from either half or both, by the mean of its log-odds
    a, b = F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1")
    n0, n1 = (sum(sizes.get((toxic, h), 0) for h in (0, 1)) for toxic in (0, 1))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    rows = [tuple(r) for r in counted.where(F.col("arc").isin(*THREATS) | (a >= 3) & (odds >= LEAST - 1)).select("arc", *_COUNTS).collect()]
    whole, halves = _grammar(rows, (0, 1), sizes), [_grammar(rows, (h,), sizes) for h in (1, 0)]
    size = len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Machine(g) for g in halves]
        for batch in batches:
            found = [machines[half].features(x or "") for x, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(size)] + [batch.column(1)], [*KINDS, "toxic"])

    schema = ", ".join(f"{k} double" for k in KINDS) + ", toxic int"
    data = np.array(texts.select(text, "toxic", "half").mapInArrow(run, schema).collect(), float).reshape(-1, size + 1)
    if len(data) < 20:
        return whole
    prior = np.array([*BUILT_IN.kinds, BUILT_IN.bias])
    fitted = _fit(np.column_stack([data[:, :size], np.ones(len(data))]), data[:, -1], prior)
    return Grammar(whole.words, whole.stems, whole.threats, tuple(float(max(0.0, w)) for w in fitted[:size]), float(fitted[size]))


def score(docs: DataFrame, grammar: Grammar, text: str = "text", keep: Sequence[str] | None = None, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1.

    Null and empty texts match no clause and get the grammar's bias alone.  Rows are independent: repeated rows repeat,
    an empty table stays empty, and a column of the new name is replaced.
    """

    def make():
        machine = Machine(grammar)
        return lambda texts: [[machine.score(x) for x in texts]]

    return with_text_columns(docs, [(column, "double")], make, text, keep)
