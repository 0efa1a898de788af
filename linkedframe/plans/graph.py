"""The tables of a linked dataset, each a DataFrame derived from its triples.

Triples come as (seq, s, p, o) with ``seq`` of any orderable type; the other tables are lazy and can be saved as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkedframe.config import Config
from linkedframe.functions import terms as T
from linkedframe.plans.positions import Positions
from linkedframe.storage import exists, remove, stored

#: Partitions by property of the saved tables; raw properties are no safe directory names.
PROPERTY_BUCKETS = 64
#: Rows (about 200 bytes each) of a table that is broadcast; larger ones are joined by shuffles.
BROADCAST = 200_000
#: Tables that are saved beside facts and page rows, and what they are sorted by.
SORTED = {
    "labels": ("n3",),
    "terms": ("n3",),
    "property_counts": ("p",),
    "value_counts": ("p", "o"),
    "linksets": ("target",),
    "blanks": ("s", "p", "o"),
    "postings": ("token", "doc_id", "pos"),
    "property_sets": ("p",),
}
#: Tables of a saved graph that only pages of lists and searches need, made when these are first asked for.
PACKED = {"blocks": ("token", "least", "block"), "group_starts": ("p", "o")}
#: Tables of which pages are read by position, and their order; made when first asked for.
POSITIONS = {"listing": ("page",), "groups": ("p", "o", "s")}
#: Postings in a block.
BLOCK = 1024


def property_bucket(c: Column) -> Column:
    """Where the rows of a property are in saved tables."""
    return F.pmod(F.xxhash64(c), F.lit(PROPERTY_BUCKETS)).cast("int")


def of_properties(rows: DataFrame, *props: str) -> DataFrame:
    """The rows of some properties; of saved tables only their buckets are read."""
    found = rows.where(F.col("p").isin(*props))
    if "p_bucket" in rows.columns and props:
        found = found.where(reduce(or_, (F.col("p_bucket") == property_bucket(F.lit(p)) for p in props)))
    return found


def _is_uri(c: Column) -> Column:
    return c.startswith("<")


def _under_base(c: Column, cfg: Config) -> Column:
    return c.startswith(f"<{cfg.base}")


def clean(triples: DataFrame, cfg: Config) -> DataFrame:
    """Triples with repaired URIs, as the load does before anything else; language tags in lower case."""

    def repaired(c: str) -> Column:
        uri = F.concat(F.lit("<"), T.safe_uri(T.uri_value(c)), F.lit(">"))
        return F.when(_is_uri(F.col(c)), uri).otherwise(F.col(c))

    o = F.when(F.col("o").rlike('"@[A-Za-z]+(-[A-Za-z0-9]+)*+$'), F.concat(F.expr("left(o, length(o) - length(substring_index(o, '\"', -1)))"), F.lower(F.substring_index("o", '"', -1)))).otherwise(repaired("o"))
    return triples.select("seq", repaired("s").alias("s"), repaired("p").alias("p"), o.alias("o"))


def page_rows(triples: DataFrame, cfg: Config, *kept: str) -> DataFrame:
    """(seq, s, p, o, page, head, direction): each triple under the pages it is shown on, from one pass over the triples.

    ``forward``: under the subject's page, ``head`` for subjects without fragment.  ``inverse``: under the object's page,
    unless its document is one of ``no_inverse``.  ``blank``: under the page of blank nodes.  Triples of which neither
    subject nor object is under the base, and that have no blank subject, go.  ``kept`` are further columns to keep.
    """
    s, o = F.col("s"), F.col("o")
    object_uri = T.uri_value(o)
    row_type = "struct<page: string, head: boolean, direction: string>"

    def row(page: Column, head: Column, direction: str) -> Column:
        return F.struct(page.alias("page"), head.alias("head"), F.lit(direction).alias("direction"))

    none = F.lit(None).cast(row_type)
    forward = F.when(_under_base(s, cfg), row(T.page_of(T.uri_value(s), cfg), ~s.contains("#"), "forward")).otherwise(none)
    hidden = T.remove_fragment(object_uri).isin(*cfg.no_inverse) if cfg.no_inverse else F.lit(False)
    inverse = F.when(_is_uri(s) & _under_base(o, cfg) & ~hidden, row(T.page_of(object_uri, cfg), F.lit(False), "inverse")).otherwise(none)
    blank = F.when(s.startswith("_:"), row(F.lit(T.BLANK_PAGE), F.lit(False), "blank")).otherwise(none)
    rows = F.explode(F.array(forward, inverse, blank))  # nulls go afterwards: a filter within the array would be worked out row by row
    return triples.select("seq", "s", "p", "o", *kept, rows.alias("r")).where("r IS NOT NULL").select("seq", "s", "p", "o", "r.*", *kept)


def pages_of(cfg: Config) -> Column:
    """On how many pages a triple is shown: its rows among :func:`page_rows`."""
    s, o = F.col("s"), F.col("o")
    hidden = T.remove_fragment(T.uri_value(o)).isin(*cfg.no_inverse) if cfg.no_inverse else F.lit(False)
    shown = (_under_base(s, cfg), _is_uri(s) & _under_base(o, cfg) & ~hidden, s.startswith("_:"))
    return reduce(Column.__add__, [F.when(c, 1).otherwise(0) for c in shown])


def join_some(rows: DataFrame, some: Column, other: DataFrame, *keys: str) -> DataFrame:
    """``rows`` left-joined with ``other``, of which only ``some`` can find anything there; the others are not shuffled."""
    some = F.coalesce(some, F.lit(False))
    return rows.where(some).join(other, list(keys), "left").unionByName(rows.where(~some), allowMissingColumns=True)


def may_have_label(c: str) -> Column:
    """Whether a term is of those that labels are of: URIs without a fragment."""
    return _is_uri(F.col(c)) & ~F.col(c).contains("#")


def _shown(triples: DataFrame, cfg: Config) -> DataFrame:
    """The triples that are on some page."""
    s, o = F.col("s"), F.col("o")
    hidden = T.remove_fragment(T.uri_value(o)).isin(*cfg.no_inverse) if cfg.no_inverse else F.lit(False)
    return triples.where(_under_base(s, cfg) | s.startswith("_:") | (_is_uri(s) & _under_base(o, cfg) & ~hidden))


def _links_of(rows: DataFrame) -> DataFrame:
    """(a, b): those of the triples that link a blank node to another one."""
    return rows.where(F.col("s").startswith("_:") & F.col("o").startswith("_:")).select(F.col("s").alias("a"), F.col("o").alias("b")).where("a <> b")


class Stars:
    """Matches of stars, steps of one subject, from (set of properties: property: (subjects, triples))."""

    def __init__(self, sets: dict[frozenset[str], dict[str, tuple[int, int]]]):
        self.sets = sets

    def counts(self) -> dict[str, int]:
        """Triples of each property."""
        out: dict[str, int] = {}
        for found in self.sets.values():
            for p, (_, triples) in found.items():
                out[p] = out.get(p, 0) + triples
        return out

    def matches(self, props: Iterable[str]) -> float:
        """How many rows a star has whose properties are each joined once, on the mean of each set of subjects."""
        wanted, total = list(props), 0.0
        for has, counts in self.sets.items():
            if has.issuperset(wanted):
                rows = float(max((counts[p][0] for p in wanted), default=0))
                for p in wanted:
                    rows *= counts[p][1] / counts[p][0]
                total += rows
        return total


class table(cached_property):
    """A table of a graph.  Of a graph with a folder, it is written there when it is first asked for."""

    def __init__(self, function: Callable[[Graph], DataFrame]):
        super().__init__(lambda graph: graph._written(function.__name__, function(graph)))
        self.__doc__ = function.__doc__


@dataclass
class Graph:
    """A dataset: its kept triples (``facts``), page rows, and derived tables; ``path`` is its folder if it is saved."""

    facts: DataFrame
    page_rows: DataFrame
    cfg: Config
    source: DataFrame | None = None
    path: str | None = None

    #: Whether no triple comes twice.
    once = False

    @classmethod
    def load(cls, triples: DataFrame, cfg: Config | None = None, dedupe: bool = False, repair: bool = True) -> Graph:
        """A graph from raw triples.  ``dedupe`` makes repeated source lines one.

        Repaired triples are written to the checkpoint folder once, since all other tables are made from them.
        """
        cfg = cfg or Config()
        source = stored(clean(triples, cfg)) if repair else triples.select("seq", "s", "p", "o")
        if dedupe:
            source = source.groupBy("s", "p", "o").agg(F.min("seq").alias("seq")).select("seq", "s", "p", "o")
        return cls(_shown(source, cfg), page_rows(source, cfg), cfg, source)

    def source_of(self, *props: str) -> DataFrame:
        """The source triples of some properties, or the kept ones where no others are known."""
        return of_properties(self.facts if self.source is None else self.source, *props)

    def facts_of(self, *props: str) -> DataFrame:
        """The kept triples of some properties."""
        return of_properties(self.facts, *props)

    def page_rows_of(self, *props: str) -> DataFrame:
        """The page rows of some properties."""
        return of_properties(self.page_rows, *props)

    def rows_where(self, can: Callable[[str, str], bool]) -> DataFrame:
        """Page rows; where a graph knows how the subjects and objects of its properties begin, those of properties that ``can`` holds for."""
        return self.page_rows

    def blank_links(self) -> DataFrame:
        """(a, b): links from blank nodes to other ones, each once."""
        return _links_of(self.blanks).distinct()

    @cached_property
    def uri_subjects(self) -> DataFrame:
        """(s): the URIs that are subjects of kept triples, each once."""
        return self.facts.where(_is_uri(F.col("s"))).select("s").distinct()

    @table
    def labels(self) -> DataFrame:
        """(n3, label): the last label of each root subject, by source order; also of subjects outside the base."""
        rows = self.source_of(*self.cfg.labels).where(~F.col("s").contains("#") & _is_uri(F.col("s")) & F.col("o").startswith('"'))
        return rows.groupBy(F.col("s").alias("n3")).agg(F.max_by(T.term_value("o"), F.struct("seq", "o")).alias("label"))

    @table
    def terms(self) -> DataFrame:
        """(n3, main, label): the dictionary of all terms on pages."""
        rows = stored(self.facts.select(F.explode(F.array("s", "p", "o")).alias("n3")).distinct())
        return join_some(rows, may_have_label("n3"), self.labels, "n3").select("n3", T.main_of("n3").alias("main"), F.nullif("label", F.lit("")).alias("label"))

    @table
    def value_counts(self) -> DataFrame:
        """(p, o, obj_label, cnt): how often each property has each value on root subjects."""
        return self._counted(self.page_rows)

    def value_counts_of(self, *props: str) -> DataFrame:
        """The counts of some properties; of a graph that is not saved, from the rows of these alone."""
        return self._counted(self.page_rows_of(*props)) if self.path is None else self.value_counts.where(F.col("p").isin(*props))

    def _counted(self, rows: DataFrame) -> DataFrame:
        counted = stored(rows.where("head").groupBy("p", "o").agg(F.count("*").alias("cnt")))
        named = join_some(counted, may_have_label("o"), self.labels.withColumnRenamed("n3", "o"), "o")
        return named.select("p", "o", F.nullif("label", F.lit("")).alias("obj_label"), "cnt")

    @table
    def linksets(self) -> DataFrame:
        """(target, cnt): links from subjects under the base to each outside dataset, those with enough of them."""
        rows = self.rows_where(lambda s, o: s.startswith("<") and o.startswith("<") and not o.startswith(f"<{self.cfg.base}"))
        links = rows.where((F.col("direction") == "forward") & _is_uri(F.col("o"))).select(T.link_target(T.uri_value("o"), self.cfg).alias("target"))
        return links.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= self.cfg.min_links)

    @cached_property
    def texts(self) -> DataFrame:
        """(s, p, text): what is searched: the objects of subjects under the base, and the labels of these objects."""
        return self._texts([])

    def _texts(self, any_of: list[str]) -> DataFrame:
        """Texts; of those without any of the given words, some are left out before they are unescaped."""

        def may_hold(c: str, escaped: bool) -> Column:
            lower = T.lower_ascii(c)
            held = reduce(or_, (lower.contains(w) for w in any_of), F.lit(not any_of))
            return held | F.col(c).contains("\\u") | F.col(c).contains("\\U") if any_of and escaped else held

        rows = self.rows_where(lambda s, o: s.startswith("<")).where("direction = 'forward'").select("s", "p", "o")
        links = self.rows_where(lambda s, o: s.startswith("<") and o.startswith("<")).where("direction = 'forward'").select("s", "p", "o")
        own = rows.where(may_hold("o", True)).select("s", "p", T.term_value("o").alias("text"))
        named = self.labels.where("label <> ''").where(may_hold("label", False)).withColumnRenamed("n3", "o")
        if any_of:  # few labels hold a word, so rows are not shuffled for them
            named = stored(named)
            named = F.broadcast(named) if named.count() <= BROADCAST else named
        return own.union(links.where(may_have_label("o")).join(named, "o").select("s", "p", F.col("label").alias("text")))

    @table
    def postings(self) -> DataFrame:
        """(token, pos, doc_id, s, p, main, doc_len): the positional index of all texts."""
        return self._postings(self.texts)

    def postings_with(self, every: list[str], some: list[str]) -> DataFrame:
        """Postings of at least all texts that hold each of ``every`` and one of ``some`` as words or parts of words.

        Saved postings are given whole, since they are sorted by token; else most texts without the longest of the words
        are left out before they are split.
        """
        if self.path is not None:
            return self.postings
        return self._postings(self._texts([max(every, key=len)] if every else some))

    @staticmethod
    def _postings(texts: DataFrame) -> DataFrame:
        docs = texts.select("s", "p", T.main_of("s").alias("main"), F.length("text").alias("doc_len"), F.xxhash64("s", "p", "text").alias("doc_id"), T.tokenize("text").alias("tokens"))
        return docs.select("s", "p", "main", "doc_len", "doc_id", F.posexplode("tokens").alias("pos", "token")).select("token", "pos", "doc_id", "s", "p", "main", "doc_len")

    @table
    def blanks(self) -> DataFrame:
        """(seq, s, p, o): the triples of blank nodes, by node."""
        return self.facts.where(F.col("s").startswith("_:")).select("seq", "s", "p", "o")

    @table
    def property_counts(self) -> DataFrame:
        """(p, cnt): triples of each property."""
        return self.facts.groupBy("p").agg(F.count("*").alias("cnt"))

    @table
    def property_sets(self) -> DataFrame:
        """(props, p, subjects, triples): for each distinct set of properties, how many subjects have it, and each of its properties how often."""
        each = self.facts.groupBy("s", "p").agg(F.count("*").alias("n"))
        sets = each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("has"))  # one for each of a subject's properties
        rows = sets.select(F.col("has.p").alias("props"), F.explode("has").alias("x"))
        return rows.groupBy("props", "x.p").agg(F.count("*").alias("subjects"), F.sum("x.n").alias("triples"))

    def stars_of(self, props: Iterable[str]) -> Stars:
        """How many matches stars of some properties have, from the sets of properties that subjects have.

        Sets are cut down to these properties before they reach the driver, so it gets a row for each of their combinations.
        """
        wanted = sorted(props)
        cut = F.array_intersect("props", F.array(*map(F.lit, wanted)))
        rows = self.property_sets.where(F.col("p").isin(*wanted)).groupBy(cut.alias("props"), "p").agg(F.sum("subjects").alias("subjects"), F.sum("triples").alias("triples"))
        found: dict[frozenset[str], dict[str, tuple[int, int]]] = {}
        for r in rows.collect():
            found.setdefault(frozenset(r["props"]), {})[r["p"]] = (r["subjects"], r["triples"])
        return Stars(found)

    @table
    def blocks(self) -> DataFrame:
        """(token, block, least, most, n, docs): postings of each word by length of their text, in blocks of ``BLOCK``."""
        order = ("token", "doc_len", "doc_id", "pos", "s", "p")
        dealt = stored(self.postings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
        docs = F.array_sort(F.collect_list(F.struct("doc_len", "doc_id", "pos", "p", "main")))
        packed = dealt.groupBy("token", F.expr(f"at div {BLOCK}").alias("block")).agg(docs.alias("docs"))
        return packed.select("token", "block", F.expr("docs[0].doc_len").alias("least"), F.element_at("docs", -1)["doc_len"].alias("most"), F.size("docs").alias("n"), "docs")

    @cached_property
    def listing(self) -> Positions:
        """(page, label) of root subjects, by page; of saved graphs."""
        rows = self.page_rows.where("head").select("page", "s").distinct().join(self.labels.withColumnRenamed("n3", "s"), "s", "left")
        return Positions.save(rows.select("page", F.coalesce(F.nullif("label", F.lit("")), T.display_node("s", self.cfg)).alias("label")), f"{self.path}/listing", *POSITIONS["listing"])

    @cached_property
    def groups(self) -> Positions:
        """(p, o, s): the subjects of each value of each property, in order; of saved graphs."""
        return Positions.save(self.facts.select("p", "o", "s").distinct(), f"{self.path}/groups", *POSITIONS["groups"])

    @table
    def group_starts(self) -> DataFrame:
        """(p, o, start, cnt): where the subjects of each value stand in :attr:`groups`."""
        return self.groups.starts("p", "o")

    def counts_of(self, props: Iterable[str]) -> dict[str, int]:
        """Triples of some properties: for ordering the steps of a pattern."""
        return {r["p"]: r["cnt"] for r in self.property_counts.where(F.col("p").isin(*props)).collect()}

    def decoded(self) -> DataFrame:
        """Page rows with the labels of subject, property and object.

        Rows are not shuffled by property, which is the most skewed of the three: the labels of properties are joined to
        the properties first, and these are broadcast if there are not too many.
        """
        named = {c: self.labels.select(F.col("n3").alias(c), F.col("label").alias(f"{c}_label")) for c in ("s", "p", "o")}
        parts = []
        for rows, can in self._by_labelled():
            for c in ("s", "o"):
                rows = rows.join(named[c], c, "left") if c in can else rows.withColumn(f"{c}_label", F.lit(None).cast("string"))
            if "p" in can:
                properties = stored(self.property_counts.select("p").join(named["p"], "p"))
                properties = F.broadcast(properties) if properties.count() <= BROADCAST else properties
                rows = rows.join(properties, "p", "left")
            else:
                rows = rows.withColumn("p_label", F.lit(None).cast("string"))
            parts.append(rows.select("seq", "s", "p", "o", "page", "head", "direction", "s_label", "p_label", "o_label"))
        return reduce(DataFrame.union, parts)

    def _by_labelled(self) -> list[tuple[DataFrame, set[str]]]:
        """Page rows in parts, each with those of s, p and o that may have a label there."""
        return [(self.page_rows, {"s", "p", "o"})]

    def _written(self, name: str, made: DataFrame) -> DataFrame:
        if self.path is None:
            return made
        order = {**SORTED, **PACKED}[name]
        if name == "postings":  # a table is dealt to ranges in two passes, one for a sample; texts are split in one
            made = stored(made)
        made.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return made.sparkSession.read.parquet(f"{self.path}/{name}")

    def save(self, path: str, whole: bool = True) -> Graph:
        """All tables as Parquet: rows by buckets of their property, sorted for skipping; postings by token.

        Ranges go on behind the property or token, so one with a large share of the rows is cut into many tasks.  Tables
        that follow from saved ones are made from these; if not ``whole``, only when they are first asked for.  Gives the
        saved graph.
        """
        spark = self.facts.sparkSession
        for name in (*PACKED, *POSITIONS):  # of a graph that was saved there before
            remove(spark, f"{path}/{name}")
        order, rows = ("p_bucket", "p", "s", "o"), self.facts.withColumn("p_bucket", property_bucket(F.col("p")))
        for name in ("facts", "page_rows"):
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("p_bucket").parquet(f"{path}/{name}")
            # each triple that is kept is on some page, so the rows of pages follow from the saved triples
            rows = page_rows(spark.read.parquet(f"{path}/{name}"), self.cfg, "p_bucket") if name == "facts" else rows
        saved = Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("facts", "page_rows")), self.cfg, path=path)
        # labels may come from triples that are on no page
        saved.__dict__["labels"] = saved._written("labels", self.labels)
        for name in SORTED if whole else ():
            getattr(saved, name)
        return saved

    @classmethod
    def open(cls, spark: SparkSession, path: str, cfg: Config | None = None) -> Graph:
        """A graph that was saved whole."""
        graph = cls(*(spark.read.parquet(f"{path}/{name}") for name in ("facts", "page_rows")), cfg or Config(), path=path)
        for name in (*SORTED, *(n for n in PACKED if exists(spark, f"{path}/{n}"))):
            graph.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        for name, by in POSITIONS.items():
            if exists(spark, f"{path}/{name}/ranges"):
                graph.__dict__[name] = Positions.open(spark, f"{path}/{name}", *by)
        return graph


class MadeGraph(Graph):
    """A graph whose triples (seq, s, p, o) are made when they are asked for, each once.

    ``some`` gives those of given properties, from less input than all, or all; URIs are taken as they are.  Where it is
    known, ``subjects`` gives the URIs that are subjects, each once, and ``begins`` how the subjects and objects of each
    property begin, as pairs.
    """

    once = True

    def __init__(self, some: Callable[..., DataFrame], cfg: Config, subjects: Callable[[], DataFrame] | None = None, begins: Mapping[str, Iterable[tuple[str, str]]] | None = None):
        self.some, self.cfg, self.subjects, self.begins = some, cfg, subjects, begins

    def _props_where(self, can: Callable[[str, str], bool]) -> list[str]:
        """The properties that ``can`` holds for some subject and object of, by how these begin."""
        return [p for p, pairs in self.begins.items() if any(can(s, o) for s, o in pairs)]

    def rows_where(self, can: Callable[[str, str], bool]) -> DataFrame:
        if self.begins is None:
            return self.page_rows
        props = self._props_where(can)
        return self.page_rows_of(*props) if props else self.page_rows.limit(0)

    @cached_property
    def blanks(self) -> DataFrame:
        """(seq, s, p, o): the triples of blank nodes, of the properties that these can have."""
        props = None if self.begins is None else self._props_where(lambda s, o: s.startswith("_:"))
        rows = self.facts if props is None else self.facts_of(*props) if props else self.facts.limit(0)
        return rows.where(F.col("s").startswith("_:")).select("seq", "s", "p", "o")

    def blank_links(self) -> DataFrame:
        props = None if self.begins is None else self._props_where(lambda s, o: s.startswith("_:") and o.startswith("_:"))
        if not props:
            return _links_of(self.facts if props is None else self.facts.limit(0)).distinct()
        found = _links_of(self.facts_of(*props))
        return found if len(props) == 1 else found.distinct()  # of one property, each triple comes once

    @cached_property
    def uri_subjects(self) -> DataFrame:
        found = self.facts.select("s").distinct() if self.subjects is None else self.subjects()
        # each kept triple with a URI as its subject is under the base, or links to there
        return found.where(_is_uri(F.col("s")))

    @cached_property
    def source(self) -> DataFrame:
        return self.some()

    @cached_property
    def facts(self) -> DataFrame:
        return _shown(self.source, self.cfg)

    @cached_property
    def page_rows(self) -> DataFrame:
        return page_rows(self.source, self.cfg)

    def source_of(self, *props: str) -> DataFrame:
        return self.some(*props)

    def facts_of(self, *props: str) -> DataFrame:
        return _shown(self.some(*props), self.cfg)

    def page_rows_of(self, *props: str) -> DataFrame:
        return page_rows(self.some(*props), self.cfg)

    def _by_labelled(self) -> list[tuple[DataFrame, set[str]]]:
        if self.begins is None:
            return super()._by_labelled()
        labelled = {s for p in self.cfg.labels for s, _ in self.begins.get(p, ())}

        def may(term: str) -> bool:
            return term.startswith("<") and any(term.startswith(x) or x.startswith(term) for x in labelled)

        groups: dict[frozenset[str], list[str]] = {}
        for p, pairs in self.begins.items():
            can = {c for c, terms in zip("so", zip(*pairs, strict=True), strict=True) if any(map(may, terms))} | ({"p"} if may(p) else set())
            groups.setdefault(frozenset(can), []).append(p)
        return [(self.page_rows_of(*props), set(can)) for can, props in groups.items()]
