"""Graph-pattern matching over triples as joins of DataFrames.

    match(facts, var("r"), [
        po("<.../language>", var("l")),
        po("<.../subset>", nested([po("<.../triples>", var("n"))])),
        optional(po("<.../label>", var("lab"))),
        either(po("<.../title>", var("t")), po("<.../label>", var("t"))),
    ])                                                       # -> DataFrame r, l, n, lab, t

The result is an ordinary DataFrame with one string column (an N3 term) for each variable; select, distinct, groupBy,
orderBy, offset and limit follow as usual.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkedframe.functions.terms import expand
from linkedframe.plans.graph import Stars, of_properties


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Nested:
    """A node known only by its own properties."""

    steps: tuple


@dataclass(frozen=True)
class Step:
    """One property with all of the listed objects."""

    prop: str
    objects: tuple


@dataclass(frozen=True)
class Optional:
    step: Step | Either
    strict: bool = False


@dataclass(frozen=True)
class Either:
    branches: tuple[Step, ...]


def var(name: str) -> Var:
    return Var(name)


def nested(steps: Sequence) -> Nested:
    return Nested(tuple(steps))


def po(prop: str, *objects, prefixes: dict[str, str] | None = None) -> Step:
    """A property (``<uri>``, or ``prefix:name`` with ``prefixes``; ``a`` is rdf:type) with terms, variables or nested nodes."""
    if not objects:
        raise ValueError("a step needs an object")
    return Step(_property(prop, prefixes), tuple(_object(o, prefixes) for o in objects))


def _property(prop: str, prefixes: dict[str, str] | None) -> str:
    if prop == "a":
        return "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    if prop.startswith("<"):
        return prop
    return f"<{expand(prop, prefixes or {})}>"


def _object(o, prefixes):
    if isinstance(o, str) and not o.startswith(("<", '"', "_:")):
        return f"<{expand(o, prefixes or {})}>"
    return o


def optional(step: Step | Either, strict: bool = False) -> Optional:
    """A step that may be missing.  ``strict`` keeps only rows that have it."""
    return Optional(step, strict)


def either(*branches: Step) -> Either:
    """Any of several steps; all must use the same variables."""
    names = {frozenset(variables([b])) for b in branches}
    if len(branches) < 2 or len(names) > 1:
        raise ValueError("alternatives must be two or more and use the same variables")
    return Either(tuple(branches))


def variables(steps: Sequence) -> list[str]:
    """Names of the variables in steps, in order of first appearance."""
    out: dict[str, None] = {}
    for step in steps:
        if isinstance(step, Optional):
            out |= dict.fromkeys(variables([step.step]))
        elif isinstance(step, Either):
            for branch in step.branches:
                out |= dict.fromkeys(variables([branch]))
        else:
            for o in step.objects:
                if isinstance(o, Var):
                    out[o.name] = None
                elif isinstance(o, Nested):
                    out |= dict.fromkeys(variables(o.steps))
    return list(out)


def properties(steps: Sequence) -> set[str]:
    """The properties of steps and of all steps inside them."""
    out: set[str] = set()
    for step in steps:
        if isinstance(step, Optional):
            out |= properties([step.step])
        elif isinstance(step, Either):
            out |= properties(step.branches)
        else:
            out.add(step.prop)
            for o in step.objects:
                out |= properties(o.steps) if isinstance(o, Nested) else set()
    return out


_SUBJECT = "__s"


class _Matcher:
    def __init__(self, facts: DataFrame, counts: dict[str, int] | None, stars: Stars | None = None):
        self.facts = facts.select(*[c for c in ("s", "p", "o", "p_bucket") if c in facts.columns])
        self.counts = counts or {}
        self.stars = stars
        self.fresh = count()

    def single(self, prop: str, o) -> DataFrame:
        """The triples of one property and object: the subject and the object's variables."""
        rows = of_properties(self.facts, prop)
        if isinstance(o, Var):
            return rows.select(F.col("s").alias(_SUBJECT), F.col("o").alias(o.name))
        if isinstance(o, Nested):
            key = f"__o{next(self.fresh)}"
            inner = self.steps(o.steps, None).withColumnRenamed(_SUBJECT, key)
            return rows.select(F.col("s").alias(_SUBJECT), F.col("o").alias(key)).join(inner, key).drop(key)
        return rows.where(F.col("o") == o).select(F.col("s").alias(_SUBJECT))

    def step(self, step: Step | Either) -> DataFrame:
        if isinstance(step, Step):
            return reduce(self.join, (self.single(step.prop, o) for o in step.objects))
        if all(len(b.objects) == 1 and not isinstance(b.objects[0], Nested) for b in step.branches):
            names = variables([step])
            conditions = []
            for b in step.branches:
                c = F.col("p") == b.prop
                conditions.append(c if isinstance(b.objects[0], Var) else c & (F.col("o") == b.objects[0]))
            # a triple that fits several branches stands for each of them
            fits = sum((c.cast("int") for c in conditions[1:]), conditions[0].cast("int"))
            rows = of_properties(self.facts, *{b.prop: None for b in step.branches}).where(reduce(Column.__or__, conditions))
            if len({b.prop for b in step.branches}) < len(step.branches):
                rows = rows.select("s", "o", F.explode(F.sequence(F.lit(1), fits)).alias("__n"))
            return rows.select(F.col("s").alias(_SUBJECT), *[F.col("o").alias(n) for n in names])
        return reduce(DataFrame.unionByName, (self.step(b) for b in step.branches))

    @staticmethod
    def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return left.join(right, [c for c in left.columns if c in right.columns], how)

    def cost(self, step) -> int:
        """Triples of a step's properties, where counts are known."""
        props = [b.prop for b in step.branches] if isinstance(step, Either) else [step.prop]
        return sum(self.counts.get(p, 1 << 62) for p in props)

    def ordered(self, needed: list) -> list:
        """Steps of one subject: the smallest first, then always the one that leaves the fewest rows.

        With only counts of properties, steps go by these.  A step with a constant object is taken to leave a tenth.
        """
        if self.stars is None:
            return sorted(needed, key=self.cost) if self.counts else needed
        out, left = [], list(needed)
        while left:
            best = min(left, key=lambda s: (self.rows([*out, s]), self.cost(s)))
            out.append(best)
            left.remove(best)
        return out

    def rows(self, steps: Sequence) -> float:
        """Rows of a star of steps; alternatives add up."""
        found = 0.0
        for props in product(*[[b.prop for b in s.branches] if isinstance(s, Either) else [s.prop] for s in steps]):
            found += self.stars.matches(props)
        constant = sum(isinstance(o, str) for s in steps if isinstance(s, Step) for o in s.objects)
        return found / 10**constant

    def steps(self, steps: Sequence, subject: Var | None) -> DataFrame:
        """All steps of one subject.  Its column is ``__s``, or the variable's name if there is one."""
        steps = [s.step if isinstance(s, Optional) and s.strict else s for s in steps]
        needed = [s for s in steps if not isinstance(s, Optional)]
        rest = [s.step for s in steps if isinstance(s, Optional)]
        maybe: set[str] = set()
        bound = set(variables(needed)) | ({subject.name} if subject else set())
        for s in rest:
            names = set(variables([s]))
            if names & maybe:
                raise ValueError(f"optional variables may be used once only: {sorted(names & maybe)}")
            maybe |= names - bound
        needed = self.ordered(needed)

        def own(df: DataFrame) -> DataFrame:
            """A step with the subject under its name; a variable that stands for both must agree."""
            if subject and subject.name in df.columns:
                return df.where(F.col(_SUBJECT) == F.col(subject.name)).drop(_SUBJECT)
            return df.withColumnRenamed(_SUBJECT, subject.name) if subject else df

        if needed:
            out = reduce(self.join, (own(self.step(s)) for s in needed))
        else:  # optional properties alone: of all subjects
            out = own(self.facts.select(F.col("s").alias(_SUBJECT)).distinct())
        for s in rest:
            out = self.join(out, own(self.step(s)), "left")
        return out


def match(facts: DataFrame, subject: Var | str | None, steps: Sequence, counts: dict[str, int] | None = None, stars: Stars | None = None) -> DataFrame:
    """Rows of the pattern: one column a variable, in order of first appearance.

    ``facts`` has columns s, p, o, and p_bucket where it is a saved table.  ``subject`` is a variable, a term, or None for a node without a name.  A variable used
    again joins on equality.  ``counts`` (property to number of triples) lets the smallest steps be joined first, ``stars``
    (see :meth:`Graph.stars_of`) those that leave the fewest rows together; without them they are joined as given.
    """
    steps = list(steps)
    if not steps:
        raise ValueError("a pattern needs a step")
    names = dict.fromkeys([subject.name] if isinstance(subject, Var) else []) | dict.fromkeys(variables(steps))
    matcher = _Matcher(facts, counts, stars)
    if isinstance(subject, str):
        # only the top node's own triples can be of this subject; nested nodes are looked up in all
        top = _Matcher(facts.where(F.col("s") == subject), counts, stars)
        top.single = lambda prop, o: _constant(matcher, prop, o, subject)
        rows = top.steps(steps, None)
    else:
        rows = matcher.steps(steps, subject)
    return rows.select(*names)


def _constant(matcher: _Matcher, prop: str, o, subject: str) -> DataFrame:
    return matcher.single(prop, o).where(F.col(_SUBJECT) == subject)


def check_limit(limit: int | None, most: int) -> int:
    """``limit`` if it is given and below ``most`` (-1: no maximum)."""
    if most >= 0 and (limit is None or limit < 0 or limit >= most):
        raise ValueError(f"a limit below {most} is required")
    return -1 if limit is None else limit


def page_of_results(df: DataFrame, limit: int, offset: int = 0) -> tuple[list, bool]:
    """The rows of one result page and whether more follow, in one action."""
    rows = df.offset(offset).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def count_by(df: DataFrame, *names: str, alias: str = "count") -> DataFrame:
    """Rows for each combination of the named variables; without any, of all rows."""
    counted = F.count("*").alias(alias)
    return df.groupBy(*names).agg(counted) if names else df.agg(counted)
