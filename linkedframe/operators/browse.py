"""Browse operators: each works on a DataFrame of pages, so one page or all of them are one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkedframe.config import RDF_TYPE, RDFS_LABEL
from linkedframe.functions import terms as T
from linkedframe.operators.reach import reached
from linkedframe.plans.graph import Graph


def closure(graph: Graph, starts: DataFrame) -> DataFrame:
    """(page, seq, s, p, o): the triples of all blank nodes that are reached from (page, node) rows, at any depth."""
    found = reached(graph, starts).select("page", F.col("node").alias("s"))
    return found.join(graph.blanks, "s").select("page", "seq", "s", "p", "o")


def starts_of(graph: Graph) -> DataFrame:
    """Page rows, those among them whose subject is a URI and whose object a blank node."""
    return graph.rows_where(lambda s, o: s.startswith("<") and o.startswith("_:"))


def lookup(graph: Graph, pages: DataFrame | None = None) -> DataFrame:
    """(page, seq, s, p, o): all rows of pages, backlinks and blank nodes included, each triple once a page.

    ``pages`` has a column ``page``; without it all pages are looked up.  Unknown pages have no rows.  Where a graph has
    each triple once, the only rows that a page has twice are forward and inverse ones, so none are compared.
    """

    def shown(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("page") != T.BLANK_PAGE)
        return rows if pages is None else rows.join(pages.select("page").distinct(), "page", "left_semi")

    rows = shown(graph.page_rows)
    if graph.once:
        rows = rows.where(~((F.col("direction") == "inverse") & T.page_of(T.uri_value("s"), graph.cfg).eqNullSafe(F.col("page"))))
    own = rows.select("page", "seq", "s", "p", "o")
    below = closure(graph, shown(starts_of(graph)).select("page", F.col("o").alias("node")))
    if graph.once:
        return own.unionByName(below)
    return own.unionByName(below).groupBy("page", "s", "p", "o").agg(F.min("seq").alias("seq")).select("page", "seq", "s", "p", "o")


def summarize(graph: Graph, pages: DataFrame | None = None, n: int = 20) -> DataFrame:
    """(page, seq, s, p, o): the first ``n`` facet triples of each page's root subject."""
    rows = graph.page_rows_of(*(f.prop for f in graph.cfg.all_facets)).where("head")
    if pages is not None:
        rows = rows.join(pages.select("page").distinct(), "page", "left_semi")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("seq", "p", "o"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("page", "seq", "s", "p", "o")


def list_resources(graph: Graph, prop: str | None = None, value: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(page, label) of root subjects, by page; optionally only those with a property, or with a value of it."""
    if value is not None and prop is None:
        raise ValueError("a value needs a property")
    if prop is None and graph.path is not None and (limit is not None or offset):
        return graph.listing.page(offset, limit)  # opens the ranges of the page only
    rows = (graph.page_rows if prop is None else graph.page_rows_of(prop)).where("head")
    if value is not None:
        rows = rows.where(F.col("o") == value)
    named = rows.select("page", "s").distinct().join(graph.labels.withColumnRenamed("n3", "s"), "s", "left")
    out = named.select("page", F.coalesce(F.nullif("label", F.lit("")), T.display_node("s", graph.cfg)).alias("label"))
    if limit is None and not offset:
        return out
    out = out.orderBy("page").offset(offset)
    return out if limit is None else out.limit(limit)


def resources_with(graph: Graph, prop: str, value: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(s, more): subjects that have a value of a property, all of them or, in order, ``limit`` behind ``offset``.

    ``more`` says whether others follow these.  Of a saved graph only the ranges that hold the page are read.
    """
    if graph.path is not None and limit is not None:
        at = graph.group_starts.where((F.col("p") == prop) & (F.col("o") == value)).select("start", "cnt").first() or {"start": 0, "cnt": 0}
        shown = max(0, min(limit, at["cnt"] - offset))
        return graph.groups.page(at["start"] + offset, shown).select("s", F.lit(at["cnt"] > offset + limit).alias("more"))
    found = graph.facts_of(prop).where(F.col("o") == value).select("s").distinct()
    if limit is None:
        found = found.orderBy("s").offset(offset) if offset else found
        return found.withColumn("more", F.lit(False))
    shown = found.orderBy("s").offset(offset).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy("s"))  # of one row more than the limit
    return shown.withColumn("rank", rank).withColumn("more", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit).select("s", "more")


def list_values(graph: Graph, prop: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(o, label, cnt): the values of a property, the most frequent first."""
    shown = F.coalesce("obj_label", T.display_node("o", graph.cfg))
    out = graph.value_counts_of(prop).select("o", shown.alias("label"), "cnt").orderBy(F.desc("cnt"), "o").offset(offset)
    return out if limit is None else out.limit(limit)


def facet_panel(graph: Graph, n: int = 20) -> DataFrame:
    """(p, name, o, label, cnt, rank, more): the ``n`` most frequent values of each listed facet, and whether it has more.

    ``name`` is the facet's own label, or else its property's.
    """
    listed = {f.prop: f.label for f in graph.cfg.all_facets if f.listed}
    counts = graph.value_counts_of(*listed)
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("cnt"), "o"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= n + 1)
    sizes = top.groupBy("p").agg((F.count("*") > n).alias("more"))
    label = T.clip(F.coalesce("obj_label", T.display_node("o", graph.cfg)))
    own = [F.when(F.col("p") == p, F.lit(name)) for p, name in listed.items() if name is not None]
    name = F.coalesce(*own, T.display_node("p", graph.cfg))
    return top.where(F.col("rank") <= n).join(F.broadcast(sizes), "p").select("p", name.alias("name"), "o", label.alias("label"), "cnt", "rank", "more")


def label_of(graph: Graph, pages: DataFrame) -> DataFrame:
    """(page, label) of pages; null without a label."""
    keyed = pages.select("page").distinct().withColumn("n3", T.name("page", None, graph.cfg))
    return keyed.join(graph.labels, "n3", "left").select("page", F.nullif("label", F.lit("")).alias("label"))


def class_of(graph: Graph) -> DataFrame:
    """(page, class): the first rdf:type of each root subject."""
    rows = graph.page_rows_of(RDF_TYPE).where("head")
    return rows.groupBy("page").agg(F.min_by("o", F.struct("seq", "o")).alias("class"))


def titles(graph: Graph) -> DataFrame:
    """(page, title): the texts of rdfs:label joined, or the name of the page's URI."""
    roots = graph.uri_subjects.where(F.col("s").startswith(f"<{graph.cfg.base}") & ~F.col("s").contains("#"))
    labels = graph.page_rows_of(RDFS_LABEL).where("head").groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(T.term_value("o"))), ", ").alias("title"))
    found = roots.join(labels, "s", "left")
    return found.select(T.page_of(T.uri_value("s"), graph.cfg).alias("page"), F.coalesce(F.nullif("title", F.lit("")), T.display_node("s", graph.cfg)).alias("title"))


def search(
    graph: Graph,
    query: str = "",
    prop: str | None = None,
    any_of: str = "",
    none_of: str = "",
    phrase: str = "",
    prefix: str = "",
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """(main, label, doc_len): documents with all words of ``query``, those with the shortest matching text first.

    A single text must hold all of: each word of ``query``, some word of ``any_of``, no word of ``none_of``, the words of
    ``phrase`` in a row, and a word that starts with each of ``prefix``.  Without a positive term nothing is found.
    """
    spark = graph.facts.sparkSession

    given = (query, any_of, none_of, phrase, prefix)
    every, some, no, row, starts = spark.range(1).select(*[T.tokenize(F.lit(x)).alias(str(i)) for i, x in enumerate(given)]).first()
    token = F.col("token")
    wanted = token.isin(*every, *some, *no, *row)
    for p in starts:
        wanted = wanted | token.startswith(p)
    having = [F.count_if(token == w) > 0 for w in {*every, *row}] + [F.count_if(token == w) == 0 for w in set(no)]
    having += [F.count_if(token.isin(*some)) > 0] if some else []
    having += [F.count_if(token.startswith(p)) > 0 for p in starts]
    ok = F.lit(bool(every or some or row or starts))
    for h in having:
        ok = ok & h
    at = F.collect_list(F.when(token.isin(*row), F.struct("pos", "token"))) if len(row) > 1 else F.array()

    def hits(rows: DataFrame) -> DataFrame:
        """(main, doc_len) of the documents with a text among these postings that meets all conditions."""
        if prop is not None:
            rows = rows.where(F.col("p") == prop)
        docs = rows.where(wanted).groupBy("doc_id", "main", "doc_len").agg(ok.alias("ok"), at.alias("at")).where("ok")
        if len(row) > 1:
            common, *others = _places(row)
            for p in others:
                common = F.array_intersect(common, p)
            docs = docs.where(F.size(common) > 0)
        return docs.groupBy("main").agg(F.min("doc_len").alias("doc_len"))

    needed = [token == w for w in {*every, *row}] + ([token.isin(*some)] if some else []) + [token.startswith(p) for p in starts]
    if limit is None or graph.path is None or not needed:
        found = hits(graph.postings_with([*every, *row, *starts], some))
    else:
        found = hits(shortest(graph, wanted, needed, hits, offset + limit)[0])
    named = found.join(graph.labels.withColumnRenamed("n3", "main"), "main", "left")
    out = named.select("main", F.coalesce(F.nullif("label", F.lit("")), T.display_node("main", graph.cfg)).alias("label"), "doc_len")
    if limit is None and not offset:
        return out
    out = out.orderBy("doc_len", "main").offset(offset)
    return out if limit is None else out.limit(limit)


#: Blocks of the rarest condition that a search reads first, and by how much it reads more each time these are too few.
FIRST, MORE = 2, 4


def shortest(graph: Graph, wanted: Column, needed: list[Column], hits: Callable[[DataFrame], DataFrame], k: int) -> tuple[DataFrame, int | None]:
    """Postings of the shortest texts, as many as it takes to find ``k`` documents, and the greatest length among them.

    Blocks of postings carry the least length of their texts, and all postings of a text have the same length; so where
    enough documents are found up to some length, nothing longer can come before them, and its blocks are not read.  The
    first length is that of a few blocks of the condition with the fewest postings.  None: all lengths were needed.
    """
    blocks, n = graph.blocks, FIRST
    sizes = blocks.select(*[F.sum(F.when(c, F.col("n"))).alias(str(i)) for i, c in enumerate(needed)]).first()
    rarest = needed[min(range(len(needed)), key=lambda i: sizes[i] or 0)]
    while True:
        some = blocks.where(rarest).select("least", "most", "block").orderBy("least", "block").limit(n)
        found, most = some.agg(F.count("*"), F.max("most")).first()
        bound = most if found == n else None
        near = blocks.where(wanted) if bound is None else blocks.where(wanted & (F.col("least") <= bound))
        rows = near.select("token", F.explode("docs").alias("d")).select("token", "d.*")
        rows = rows if bound is None else rows.where(F.col("doc_len") <= bound)
        if bound is None or hits(rows).limit(k).count() >= k:
            return rows, bound
        n *= MORE


def _places(row: list[str]):
    """For each word of a phrase, where the phrase would start."""
    out = []
    for i, word in enumerate(row):
        quoted = word.replace("\\", "\\\\").replace("'", "\\'")
        out.append(F.expr(f"transform(filter(at, x -> x.token = '{quoted}'), x -> x.pos - {i})"))
    return out
