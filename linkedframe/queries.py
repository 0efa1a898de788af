"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkedframe import testmap
from linkedframe.config import RDF_TYPE, RDFS_LABEL, RDFS_NAMESPACES
from linkedframe.functions import terms as T
from linkedframe.operators import browse, documents, rewrite, stats
from linkedframe.operators.pattern import count_by, either, match, nested, optional, po, properties, var
from linkedframe.plans.graph import Graph
from linkedframe.sources import results, tables
from linkedframe.sources.jsonld import read_jsonld
from linkedframe.storage import stored
from linkedframe.testmap import BASE, CONFIG, DC, ONTOLOGY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL that stands before the oracles: triples, page rows, labels.
_WITH = {
    "facts": testmap.FACTS_SQL,
    "page_rows": f"""
      SELECT s, p, o, split_part(substr(s, 24, length(s) - 24), '#', 1) AS page, position('#' in s) = 0 AS head, 'forward' AS direction FROM facts WHERE starts_with(s, '<{BASE}')
      UNION ALL SELECT s, p, o, split_part(substr(o, 24, length(o) - 24), '#', 1), false, 'inverse' FROM facts
        WHERE starts_with(s, '<') AND starts_with(o, '<{BASE}') AND NOT starts_with(o, '<{ONTOLOGY}')
      UNION ALL SELECT s, p, o, '<BLANK>', false, 'blank' FROM facts WHERE starts_with(s, '_:')""",
    "labels": f"""
      SELECT s AS n3, regexp_extract(max(o), '^"(.*)"[^"]*$', 1) AS label FROM facts
      WHERE p = '{RDFS_LABEL}' AND position('#' in s) = 0 AND starts_with(s, '<') GROUP BY s""",
    "reach": """
      SELECT DISTINCT page, o AS node FROM page_rows WHERE starts_with(o, '_:') AND page <> '<BLANK>'
      UNION SELECT page, o FROM reach JOIN facts ON s = node WHERE starts_with(o, '_:')""",
    "value_counts": "SELECT p, o, label AS obj_label, count(*) AS cnt FROM page_rows LEFT JOIN labels ON n3 = o WHERE head GROUP BY ALL",
}


def _p(name: str) -> str:
    return f"<{ONTOLOGY}{name}>"


def found(g: Graph, subject, steps: list) -> DataFrame:
    """A pattern in the graph; of a saved one, its steps in the order that leaves the fewest rows, by the sets of properties of subjects.

    Of triples that are made as they are read, counting these sets would cost as much as the joins, so steps stay as they are given.
    """
    if g.path is None:
        return match(g.facts_of(*properties(steps)), subject, steps)
    stars = g.stars_of(properties(steps))
    return match(g.facts, subject, steps, stars.counts(), stars)


def query(name: str, sql: str | None = None, raw: bool = False):
    """Registers a query on the graph of the tables, or on the ``raw`` triples; ``sql`` may use the names of ``_WITH``."""

    def add(function: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function((testmap.triples if raw else testmap.graph)(spark, sf_dir))
        if sql:
            ORACLES[name] = "WITH RECURSIVE " + ", ".join(f"{k} AS {'MATERIALIZED ' if k == 'facts' else ''}({v})" for k, v in _WITH.items()) + " " + sql
        return function

    return add


@query("a5_triplify", "SELECT s, p, o FROM facts", raw=True)
def _(triples):
    return triples


@query("b2_subject", f"SELECT o AS x FROM facts WHERE s = '<{BASE}nation/3>' AND p = '{_p('region')}'")
def _(g):
    return found(g, f"<{BASE}nation/3>", [po(_p("region"), var("x"))])


@query("b3_object", f"""SELECT s AS x FROM facts WHERE p = '{_p("segment")}' AND o = '"MACHINERY"@en'""")
def _(g):
    return found(g, var("x"), [po(_p("segment"), '"MACHINERY"@en')])


@query("b5_same", f"SELECT s AS x FROM facts WHERE p = '{_p('within')}' AND s = o")
def _(g):
    return found(g, var("x"), [po(_p("within"), var("x"))])


@query("b10_page_filter", "SELECT page, count(*) AS cnt FROM page_rows WHERE page <> '<BLANK>' AND head GROUP BY page")
def _(g):
    return g.page_rows.where((F.col("page") != T.BLANK_PAGE) & F.col("head")).groupBy("page").agg(F.count("*").alias("cnt"))


@query("j1_star", f"SELECT a.s AS c, a.o AS l, b.o AS n FROM facts a JOIN facts b ON a.s = b.s WHERE a.p = '{RDFS_LABEL}' AND b.p = '{_p('nation')}'")
def star(g):
    return found(g, var("c"), [po(RDFS_LABEL, var("l")), po(_p("nation"), var("n"))])


@query("j2_object_list", f"""SELECT a.s AS i FROM facts a JOIN facts b ON a.s = b.s WHERE a.p = '{_p("flag")}' AND b.p = a.p AND a.o = '"A"' AND b.o = '"R"'""")
def _(g):
    return found(g, var("i"), [po(_p("flag"), '"A"', '"R"')])


@query("j3_path", f"""SELECT a.s AS c, l.o AS l FROM facts a JOIN facts b ON a.o = b.s JOIN facts l ON l.s = a.s
  WHERE a.p = '{_p("account")}' AND b.p = '{_p("segment")}' AND b.o = '"BUILDING"@en' AND l.p = '{RDFS_LABEL}'""")
def _(g):
    return found(g, var("c"), [po(_p("account"), nested([po(_p("segment"), '"BUILDING"@en')])), po(RDFS_LABEL, var("l"))])


def _each(**props: str) -> str:
    """SQL for the triples of each property as a table (s, o) of its own."""
    return ", ".join(f"{name} AS MATERIALIZED (SELECT s, o FROM facts WHERE p = '{p}')" for name, p in props.items())


@query("j3_nested_deep", f""", {_each(item=_p("item"), flag=_p("flag"), part=_p("part"), label=RDFS_LABEL, size=_p("size"), customer=_p("customer"))},
  parts AS MATERIALIZED (SELECT label.s, label.o AS name, size.o AS size FROM label JOIN size ON size.s = label.s),
  items AS MATERIALIZED (SELECT part.s, name, size FROM part JOIN flag ON flag.s = part.s JOIN parts ON parts.s = part.o WHERE flag.o = '"R"')
  SELECT item.s AS ord, customer.o AS customer, name, size FROM item JOIN items ON items.s = item.o JOIN customer ON customer.s = item.s""")
def deep(g):
    part = nested([po(RDFS_LABEL, var("name")), po(_p("size"), var("size"))])
    return found(g, var("ord"), [po(_p("customer"), var("customer")), po(_p("item"), nested([po(_p("flag"), '"R"'), po(_p("part"), part)]))]).select("ord", "customer", "name", "size")


@query("j4_repeated", f"""SELECT a.s AS x, a.o AS n FROM facts a JOIN facts b ON a.o = b.o JOIN facts c ON c.o = b.o
  WHERE a.p = '{_p("nation")}' AND b.p = a.p AND b.s = '<{BASE}supplier/1>' AND c.p = a.p AND c.s = a.s""")
def _(g):
    mine = found(g, f"<{BASE}supplier/1>", [po(_p("nation"), var("n"))])
    return found(g, var("x"), [po(_p("nation"), var("n")), po(_p("nation"), var("n"))]).join(mine, "n").select("x", "n")


@query("j5_optional", f"SELECT a.s AS part, a.o AS l, b.o AS size FROM facts a LEFT JOIN (SELECT * FROM facts WHERE p = '{_p('size')}') b ON a.s = b.s WHERE a.p = '{RDFS_LABEL}' AND starts_with(a.s, '<{BASE}part/')")
def _(g):
    return found(g, var("part"), [po(RDFS_LABEL, var("l")), optional(po(_p("size"), var("size")))]).where(F.col("part").startswith(f"<{BASE}part/"))


@query("j5_strict", f"SELECT a.s AS part, a.o AS l, b.o AS size FROM facts a JOIN facts b ON a.s = b.s WHERE a.p = '{RDFS_LABEL}' AND b.p = '{_p('size')}'")
def _(g):
    return found(g, var("part"), [po(RDFS_LABEL, var("l")), optional(po(_p("size"), var("size")), strict=True)])


@query("j6_alternatives", f"SELECT s AS x, o AS t FROM facts WHERE p IN ('{RDFS_LABEL}', '<{DC}description>')")
def _(g):
    return found(g, var("x"), [either(po(RDFS_LABEL, var("t")), po(f"<{DC}description>", var("t")))])


@query("j6_alternatives_nested", f"""SELECT a.s AS x, b.o AS t FROM facts a JOIN facts b ON a.o = b.s WHERE a.p = '{_p("nation")}' AND b.p = '{RDFS_LABEL}'
  UNION ALL SELECT s, o FROM facts WHERE p = '{RDFS_LABEL}'""")
def _(g):
    return found(g, var("x"), [either(po(_p("nation"), nested([po(RDFS_LABEL, var("t"))])), po(RDFS_LABEL, var("t")))])


@query("j7_optional_alternatives", f"""SELECT a.s AS part, b.o AS v FROM facts a LEFT JOIN (SELECT * FROM facts WHERE p IN ('{_p("size")}', '{RDFS_LABEL}')) b ON a.s = b.s WHERE a.p = '{RDF_TYPE}'""")
def _(g):
    return found(g, var("part"), [po(RDF_TYPE, var("type")), optional(either(po(_p("size"), var("v")), po(RDFS_LABEL, var("v"))))]).select("part", "v")


@query("j8_decode", """SELECT s, p, o, page, head, direction, a.label AS s_label, b.label AS p_label, c.label AS o_label FROM page_rows
  LEFT JOIN labels a ON a.n3 = s LEFT JOIN labels b ON b.n3 = p LEFT JOIN labels c ON c.n3 = o""")
def _(g):
    return g.decoded().drop("seq")


@query("j10_closure", """, x AS (SELECT DISTINCT page, o AS node FROM page_rows WHERE starts_with(o, '_:') AND direction = 'forward' UNION SELECT page, o FROM x JOIN facts ON s = node WHERE starts_with(o, '_:'))
  SELECT DISTINCT page, s, p, o FROM x JOIN facts ON s = node""")
def _(g):
    starts = browse.starts_of(g).where("direction = 'forward'").select("page", F.col("o").alias("node"))
    return browse.closure(g, starts).select("page", "s", "p", "o")


@query("j11_texts", """SELECT s, p, t AS text FROM (
    SELECT s, p, CASE WHEN starts_with(o, '"') THEN replace(replace(replace(regexp_extract(o, '^"((?s:.*))"[^"]*$', 1), '\\n', chr(10)), '\\"', '"'), '\\\\', '\\')
      WHEN starts_with(o, '<') THEN substr(o, 2, length(o) - 2) ELSE substr(o, 3) END AS t FROM page_rows WHERE direction = 'forward'
    UNION ALL SELECT s, p, label FROM page_rows JOIN labels ON n3 = o WHERE direction = 'forward')""")
def _(g):
    return g.texts.select("s", "p", "text")


@query("g1_count", f"SELECT count(*) AS c FROM facts WHERE p = '{_p('item')}'")
def _(g):
    return count_by(found(g, var("x"), [po(_p("item"), var("i"))]), alias="c")


@query("g2_count_by", f"SELECT o AS c, count(*) AS n FROM facts WHERE p = '{_p('customer')}' GROUP BY o")
def _(g):
    return count_by(found(g, var("x"), [po(_p("customer"), var("c"))]), "c", alias="n")


@query("g3_distinct", f"SELECT DISTINCT o AS t FROM facts WHERE p = '{RDF_TYPE}'")
def _(g):
    return found(g, var("x"), [po(RDF_TYPE, var("t"))]).select("t").distinct()


@query("g4_value_counts", "SELECT p, o, obj_label, cnt FROM value_counts")
def _(g):
    return g.value_counts


_LINKS = f"""(SELECT CASE WHEN starts_with(u, 'http://dbpedia.org/') THEN 'http://dbpedia.org/' ELSE regexp_extract(u, '^(https?://[^/?#]*)', 1) || '/' END AS target
  FROM (SELECT substr(o, 2, length(o) - 2) AS u FROM page_rows WHERE direction = 'forward' AND starts_with(o, '<http'))
  WHERE NOT ({' OR '.join(f"starts_with(u, '{x}')" for x in (BASE, *testmap.NOT_LINKED))}))"""


@query("g5_linksets", f"SELECT target, count(*) AS cnt FROM {_LINKS} GROUP BY target")
def _(g):
    return g.linksets


@query("g6_triple_count", "SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM page_rows) AS shown")
def _(g):
    return stats.triple_counts(g)


@query("g7_labels", "SELECT n3, label FROM labels")
def _(g):
    return g.labels


@query("g8_terms", """SELECT t.n3, CASE WHEN starts_with(t.n3, '<') AND position('#' in t.n3) > 0 THEN split_part(t.n3, '#', 1) || '>' ELSE t.n3 END AS main, label
  FROM (SELECT DISTINCT unnest([s, p, o]) AS n3 FROM facts) t LEFT JOIN labels USING (n3)""")
def _(g):
    return g.terms


@query("g9_shared_blanks", "SELECT page, o FROM page_rows WHERE starts_with(o, '_:') GROUP BY page, o HAVING count(*) > 1")
def _(g):
    return stats.shared_blanks(g.rows_where(lambda s, o: o.startswith("_:")))


@query("g10_resource_properties", "SELECT page, p, bool_and(NOT starts_with(o, '\"')) AS all_resources FROM page_rows GROUP BY page, p")
def _(g):
    return stats.resource_properties(g.page_rows)


@query("g11_prefixes", f"""SELECT page, k AS prefix FROM page_rows, (VALUES ('rdf', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#'), ('rdfs', '<http://www.w3.org/2000/01/rdf-schema#'), ('dct', '<http://purl.org/dc/terms/')) v(k, ns)
  WHERE starts_with(s, ns) OR starts_with(p, ns) OR starts_with(o, ns) GROUP BY page, k""")
def _(g):
    return stats.prefixes_used(g.page_rows, {k: CONFIG.all_prefixes[k] for k in ("rdf", "rdfs", "dct")})


@query("o1_sorted", f"SELECT s AS x, o AS l FROM facts WHERE p = '{RDFS_LABEL}' ORDER BY o DESC, s LIMIT 25 OFFSET 10")
def _(g):
    return found(g, var("x"), [po(RDFS_LABEL, var("l"))]).orderBy(F.desc("l"), "x").offset(10).limit(25)


@query("s2_page_rows", "SELECT s, p, o, page, head, direction FROM page_rows")
def _(g):
    return g.page_rows.drop("seq", "p_bucket")


@query("f1_term_parts", """SELECT DISTINCT o AS n3, CASE WHEN starts_with(o, '<') THEN 'uri' WHEN starts_with(o, '_:') THEN 'bnode' ELSE 'literal' END AS type,
  CASE WHEN starts_with(o, '"') THEN nullif(regexp_extract(o, '"@([a-zA-Z-]+)$', 1), '') END AS lang,
  CASE WHEN starts_with(o, '"') THEN nullif(regexp_extract(o, '"\\^\\^<([^<>"]*)>$', 1), '') END AS datatype,
  CASE WHEN starts_with(o, '"') THEN replace(replace(replace(regexp_extract(o, '^"((?s:.*))"[^"]*$', 1), '\\n', chr(10)), '\\"', '"'), '\\\\', '\\')
    WHEN starts_with(o, '<') THEN substr(o, 2, length(o) - 2) ELSE substr(o, 3) END AS value FROM facts""")
def _(g):
    parts = [f.alias(n) for n, f in (("type", T.term_type("o")), ("lang", T.term_lang("o")), ("datatype", T.term_datatype("o")), ("value", T.term_value("o")))]
    return g.facts.select("o").distinct().select(F.col("o").alias("n3"), *parts)


@query("f2_to_n3", "SELECT DISTINCT o AS n3, o AS again FROM facts")
def _(g):
    again = T.to_n3(T.term_type("o"), T.term_value("o"), T.term_lang("o"), T.term_datatype("o"))
    return g.facts.select("o").distinct().select(F.col("o").alias("n3"), again.alias("again"))


@query("f7_uri_parts", """SELECT DISTINCT s, split_part(substr(s, 24, length(s) - 24), '#', 1) AS page, CASE WHEN position('#' in s) > 0 THEN substr(split_part(s, '#', 2), 1, length(split_part(s, '#', 2)) - 1) END AS fragment,
  CASE WHEN position('#' in s) > 0 THEN split_part(s, '#', 1) || '>' ELSE s END AS main, split_part(substr(s, 2, length(s) - 2), '#', 1) AS document FROM facts WHERE starts_with(s, '<')""")
def _(g):
    uri = T.term_value("s")
    rows = g.facts.where(F.col("s").startswith("<")).select("s").distinct()
    return rows.select("s", T.page_of(uri, CONFIG).alias("page"), T.fragment_of(uri).alias("fragment"), T.main_of("s").alias("main"), T.remove_fragment(uri).alias("document"))


@query("f12_link_target", f"SELECT target FROM {_LINKS}")
def _(g):
    return g.page_rows.where("direction = 'forward' AND startswith(o, '<')").select(T.link_target(T.term_value("o"), CONFIG).alias("target")).where("target IS NOT NULL")


_MAGIC = "upper(substr({0}, 1, 1)) || substr({0}, 2)".format("replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')")


def _named(uri: str, label: str = "NULL") -> str:
    """The display of a URI term, whose label may be known."""
    inner = f"substr({uri}, 2, length({uri}) - 2)"
    cases = [f"WHEN starts_with({uri}, '<{BASE}') THEN coalesce({label}, {_MAGIC.format(f'substr({inner}, {len(BASE) + 1})')})"]
    cases += [f"WHEN starts_with({uri}, '<{ns}') THEN {_MAGIC.format(f'substr({inner}, {len(ns) + 1})')}" for ns, _ in RDFS_NAMESPACES.values()]
    return f"CASE {' '.join(cases)} ELSE {inner} END"


_UNESCAPED = """replace(replace(replace(regexp_extract({0}, '^"((?s:.*))"[^"]*$', 1), '\\n', chr(10)), '\\"', '"'), '\\\\', '\\')"""


@query("f15_display", f"""SELECT DISTINCT s, coalesce(label, page) AS plain, coalesce(label, {_MAGIC.format("page")}) AS pretty
  FROM (SELECT s, substr(s, 24, length(s) - 24) AS page FROM facts WHERE starts_with(s, '<{BASE}')) x LEFT JOIN labels ON n3 = s""")
def _(g):
    rows = g.uri_subjects.where(F.col("s").startswith(f"<{BASE}")).join(g.labels.withColumnRenamed("n3", "s"), "s", "left")
    uri = T.term_value("s")
    return rows.select("s", T.display_default(uri, CONFIG, F.col("label")).alias("plain"), T.display_pretty(uri, CONFIG, F.col("label")).alias("pretty"))


@query("f25_native", f"""SELECT s, CAST(regexp_extract(o, '^"(.*)"', 1) AS BIGINT) AS n, NULL::DATE AS d FROM facts WHERE p = '{_p("size")}'
  UNION ALL SELECT s, NULL, CAST(regexp_extract(o, '^"(.*)"', 1) AS DATE) FROM facts WHERE p = '<{testmap.DCT}issued>'""")
def _(g):
    rows = g.facts_of(_p("size"), f"<{testmap.DCT}issued>")
    return rows.select("s", T.native_integer("o").alias("n"), T.native_date("o").alias("d"))


_TOKENS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("f26_tokenize", f"SELECT token, count(*) AS cnt FROM (SELECT unnest({_TOKENS.format('label')}) AS token FROM labels) GROUP BY token")
def _(g):
    return g.labels.select(F.explode(T.tokenize("label")).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


_LOOKUP = """SELECT DISTINCT page, s, p, o FROM page_rows WHERE page <> '<BLANK>'
  UNION SELECT page, s, p, o FROM reach JOIN facts ON s = node"""


@query("h1_lookup", _LOOKUP)
def lookup_all(g):
    return browse.lookup(g).drop("seq")


@query("h2_summary", f"""SELECT page, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s, p, o) AS k FROM page_rows
  WHERE head AND p IN ({", ".join(f"'{f.prop}'" for f in CONFIG.all_facets)})) WHERE k <= 20""")
def _(g):
    return browse.summarize(g).drop("seq")


@query("h3_list", f"SELECT DISTINCT page, coalesce(label, {_MAGIC.format('page')}) AS label FROM page_rows LEFT JOIN labels ON n3 = s WHERE head")
def _(g):
    return browse.list_resources(g)


@query("h3_list_by_value", f"""SELECT DISTINCT page, label FROM page_rows LEFT JOIN labels ON n3 = s WHERE head AND p = '{_p("nation")}' AND o = '<{BASE}nation/7>' ORDER BY page LIMIT 20 OFFSET 3""")
def _(g):
    return browse.list_resources(g, _p("nation"), f"<{BASE}nation/7>", 20, 3)


@query("h4_list_values", f"SELECT o, obj_label AS label, cnt FROM value_counts WHERE p = '{_p('nation')}' ORDER BY cnt DESC, o LIMIT 10 OFFSET 2")
def _(g):
    return browse.list_values(g, _p("nation"), 10, 2)


def _search_sql(condition: str, where: str = "true") -> str:
    """Documents whose texts meet a condition on ``t``, their list of tokens."""
    texts = f"""SELECT s, p, length(v) AS n, {_TOKENS.format("v")} AS t FROM (
      SELECT s, p, replace(replace(replace(regexp_extract(o, '^"((?s:.*))"[^"]*$', 1), '\\n', chr(10)), '\\"', '"'), '\\\\', '\\') AS v FROM page_rows WHERE direction = 'forward' AND starts_with(o, '"')
      UNION ALL SELECT s, p, substr(o, 2, length(o) - 2) FROM page_rows WHERE direction = 'forward' AND starts_with(o, '<')
      UNION ALL SELECT s, p, substr(o, 3) FROM page_rows WHERE direction = 'forward' AND starts_with(o, '_:')
      UNION ALL SELECT s, p, label FROM page_rows JOIN labels ON n3 = o WHERE direction = 'forward')"""
    main = "CASE WHEN position('#' in s) > 0 THEN split_part(s, '#', 1) || '>' ELSE s END"
    page = "substr(main, 24, length(main) - 24)"
    return f"""SELECT main, coalesce(label, {_MAGIC.format(page)}) AS label, doc_len FROM (
      SELECT {main} AS main, min(n)::INT AS doc_len FROM ({texts}) WHERE {where} AND {condition} GROUP BY 1) LEFT JOIN labels ON n3 = main"""


@query("h5_search", _search_sql("list_has_all(t, ['customer', '000000001'])") + " ")
def _(g):
    return browse.search(g, "Customer 000000001")


@query("h5_search_first", _search_sql("list_contains(t, 'the')") + " ORDER BY doc_len, main LIMIT 20 OFFSET 5")
def _(g):
    return browse.search(g, "the", limit=20, offset=5)


@query("h3_list_page", f"SELECT DISTINCT page, coalesce(label, {_MAGIC.format('page')}) AS label FROM page_rows LEFT JOIN labels ON n3 = s WHERE head ORDER BY page LIMIT 20 OFFSET 1500")
def _(g):
    return browse.list_resources(g, limit=20, offset=1500)


@query("h5_search_any_none", _search_sql("list_contains(t, 'that') AND list_has_any(t, ['was', 'with']) AND NOT list_contains(t, 'for')", f"p = '<{DC}description>'"))
def search_text(g):
    return browse.search(g, "that", prop=f"<{DC}description>", any_of="was with", none_of="for")


@query("h5_search_phrase", _search_sql("position(' of the ' in ' ' || array_to_string(t, ' ') || ' ') > 0"))
def _(g):
    return browse.search(g, phrase="of the")


@query("h5_search_prefix", _search_sql("len(list_filter(t, lambda x: starts_with(x, 'build'))) > 0"))
def _(g):
    return browse.search(g, prefix="Build")


@query("h6_labels", "SELECT DISTINCT page, label FROM (SELECT DISTINCT page FROM page_rows WHERE page <> '<BLANK>') LEFT JOIN labels ON n3 = '<http://localhost:8080/' || page || '>'")
def _(g):
    return browse.label_of(g, g.page_rows.where(F.col("page") != T.BLANK_PAGE))


def _pairs_sql(depth: int) -> str:
    """The property-value pairs of blank nodes as text, by (node, pairs)."""
    nested = "NULL::VARCHAR" if depth == 1 else "x.pairs"
    join = "" if depth == 1 else f" LEFT JOIN ({_pairs_sql(depth - 1)}) x ON x.node = f.o"
    return f"""SELECT s AS node, string_agg(DISTINCT p || ' ' || f.o || coalesce('(' || {nested} || ')', ''), ' ' ORDER BY p || ' ' || f.o || coalesce('(' || {nested} || ')', '')) AS pairs
      FROM facts f{join} WHERE starts_with(s, '_:') GROUP BY s"""


def _pairs(column: str, depth: int) -> str:
    """The same from nested columns."""
    inner = "" if depth == 1 else f", coalesce(concat('(', {_pairs(f'x{depth}.nested', depth - 1)}, ')'), '')"
    return f"array_join(array_sort(array_distinct(transform({column}, x{depth} -> concat(x{depth}.p, ' ', x{depth}.value{inner})))), ' ')"


_CLASSES = f"(SELECT page, min(o) AS class FROM page_rows WHERE head AND p = '{RDF_TYPE}' GROUP BY page)"


@query("h8_documents", f"""
  , own AS (SELECT r.*, class, l.label AS s_label, v.label AS o_label, pairs FROM page_rows r LEFT JOIN {_CLASSES} c USING (page) LEFT JOIN labels l ON l.n3 = s LEFT JOIN labels v ON v.n3 = o
    LEFT JOIN ({_pairs_sql(3)}) n ON n.node = o WHERE direction = 'forward'),
  subjects AS (SELECT DISTINCT page, s, {_named('s', 's_label')} AS label, CASE WHEN head THEN class END AS class FROM own)
  SELECT u.*, {_named('p')} AS p_display, x.p, x.term, x.display, x.nested, x.inverse FROM subjects u JOIN (
    SELECT DISTINCT page, s, p, o AS term, CASE WHEN starts_with(o, '<') THEN {_named('o', 'o_label')} WHEN starts_with(o, '"') THEN {_UNESCAPED.format('o')} ELSE '' END AS display, pairs AS nested, false AS inverse
    FROM own WHERE NOT (head AND p = '{RDF_TYPE}' AND o = class)
    UNION ALL SELECT DISTINCT page, o, p, s, NULL, NULL, true FROM page_rows WHERE direction = 'inverse' AND split_part(substr(s, {len(BASE) + 2}, length(s) - {len(BASE) + 2}), '#', 1) <> page
  ) x ON x.page = u.page AND x.s = u.s""")
def _(g):
    rows = documents.page_documents(g)
    value = F.transform("x.values", lambda v: F.struct(v["term"].alias("term"), v["display"].alias("display"), v["nested"].alias("nested")))
    own = rows.select("page", "s", "label", "class", F.explode("properties").alias("x")).select("page", "s", "label", "class", "x.p", F.col("x.display").alias("p_display"), F.explode(value).alias("v"))
    own = own.select("page", "s", "label", "class", "p", "p_display", "v.term", "v.display", F.expr(_pairs("v.nested", 3)).alias("nested"), F.lit(False).alias("inverse"))
    back = rows.select("page", "s", "label", "class", F.explode("inverses").alias("x")).select("page", "s", "label", "class", "x.p", F.col("x.display").alias("p_display"), F.explode("x.subjects").alias("term"))
    return own.unionByName(back.withColumn("inverse", F.lit(True)), allowMissingColumns=True)


@query("h8_property_tree", f"""
  , own AS (SELECT DISTINCT page, s AS node, p, o FROM page_rows LEFT JOIN {_CLASSES} c USING (page) WHERE direction = 'forward' AND NOT (head AND p = '{RDF_TYPE}' AND o = coalesce(class, ''))),
  far AS (SELECT page, o AS node, 0 AS level FROM own WHERE starts_with(o, '_:') UNION SELECT page, o, level + 1 FROM far JOIN facts ON s = node WHERE starts_with(o, '_:')),
  places AS (SELECT page, node, min(level) AS level FROM far GROUP BY ALL),
  whole AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY page, node, p, o) AS n FROM (SELECT *, -1 AS level FROM own UNION ALL SELECT DISTINCT page, node, p, o, level FROM places JOIN facts ON s = node)),
  put AS MATERIALIZED (SELECT page, o AS node, min(n) AS n, arg_min(w.node, n) AS parent FROM whole w JOIN places x USING (page) WHERE x.node = w.o AND x.level = w.level + 1 GROUP BY page, o),
  tree AS (SELECT page, node, parent AS top, n::VARCHAR AS path FROM put WHERE NOT starts_with(parent, '_:') UNION ALL SELECT put.page, put.node, top, path || '/' || n FROM tree JOIN put ON put.page = tree.page AND put.parent = tree.node)
  SELECT w.page, coalesce(top, w.node) AS s, coalesce(path || '/', '') || w.n AS path, w.node, w.p, w.o, put.n IS NOT NULL AS inside,
    CASE WHEN starts_with(w.o, '<') THEN {_named('w.o', 'label')} WHEN starts_with(w.o, '"') THEN {_UNESCAPED.format('w.o')} ELSE '' END AS display
  FROM whole w LEFT JOIN tree t ON t.page = w.page AND t.node = w.node LEFT JOIN put ON put.n = w.n LEFT JOIN labels l ON l.n3 = w.o""")
def _(g):
    return documents.property_tree(g).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("h9_class", f"SELECT page, min(o) AS class FROM page_rows WHERE head AND p = '{RDF_TYPE}' GROUP BY page")
def _(g):
    return browse.class_of(g)


@query("h10_titles", f"""SELECT page, coalesce(string_agg(regexp_extract(o, '^"(.*)"[^"]*$', 1), ', ' ORDER BY o) FILTER (p = '{RDFS_LABEL}'), {_MAGIC.format('page')}) AS title FROM page_rows WHERE head GROUP BY page""")
def _(g):
    return browse.titles(g)


@query("h11_facet_panel", f"""SELECT p, CASE WHEN p = '{RDF_TYPE}' THEN 'Kind' ELSE {_named('p')} END AS name, o, substr(label, 1, 100) AS label, cnt, rank, n > 20 AS more FROM (
    SELECT p, o, cnt, row_number() OVER (PARTITION BY p ORDER BY cnt DESC, o)::INT AS rank, count(*) OVER (PARTITION BY p) AS n,
      CASE WHEN starts_with(o, '"') THEN regexp_extract(o, '^"(.*)"[^"]*$', 1) ELSE coalesce(obj_label, {_MAGIC.format("substr(o, 24, length(o) - 24)")}) END AS label
    FROM value_counts WHERE p IN ('{RDFS_LABEL}', '{RDF_TYPE}', '{_p("segment")}')) WHERE rank <= 20""")
def _(g):
    return browse.facet_panel(g)


_VOID, _DCAT = "http://rdfs.org/ns/void#", "http://www.w3.org/ns/dcat#"


@query("h12_description", f"""
  , sets AS (SELECT target, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, target) AS n FROM {_LINKS} GROUP BY target),
  named AS (SELECT *, '<{BASE}description#LinkSet-' || n || '>' AS link FROM sets)
  SELECT '<{BASE}description' || s AS s, '<' || p || '>' AS p, o FROM (VALUES
    ('>', '{testmap.RDF}type', '<{_DCAT}Dataset>'), ('>', '{testmap.RDF}type', '<{_VOID}Dataset>'), ('>', '{_DCAT}title', '"Dataset"@en'), ('>', '{testmap.LABEL}', '"Dataset"@en'),
    ('>', '{_DCAT}landingPage', '<{BASE}>'), ('>', '{DC}language', '"en"'), ('>', '{_VOID}rootResource', '<{BASE}resources>'), ('>', 'http://www.w3.org/ns/odrl/2/license', '<{BASE}license>'),
    ('>', '{_VOID}sparqlEndpoint', '<{BASE}query>'), ('>', '{_DCAT}distribution', '<{BASE}description#Dump>'), ('#Dump>', '{testmap.RDF}type', '<{_DCAT}Distribution>'),
    ('#Dump>', '{_DCAT}downloadURL', '<{BASE}dump.nt.gz>'), ('#Dump>', '{DC}format', '"application/x-gzip"')) v(s, p, o)
  UNION ALL SELECT unnest(['<{BASE}description>', '<{BASE}description#Dump>']), '<{_VOID}triples>', '"' || count(*) || '"^^<{T.XSD}integer>' FROM facts
  UNION ALL SELECT '<{BASE}description>', '<{_VOID}exampleResource>', '<{BASE}' || min(page) || '>' FROM page_rows WHERE head
  UNION ALL SELECT '<{BASE}description>', '<{_VOID}subset>', link FROM named
  UNION ALL SELECT link, '{RDF_TYPE}', '<{_VOID}LinkSet>' FROM named
  UNION ALL SELECT link, '<{_VOID}subjectsTarget>', '<{BASE}description>' FROM named
  UNION ALL SELECT link, '<{_VOID}target>', '<' || target || '>' FROM named
  UNION ALL SELECT link, '<{_VOID}triples>', '"' || cnt || '"^^<{T.XSD}integer>' FROM named""")
def _(g):
    return stats.describe_dataset(g)


_DECORATED = ("uri", "display", "value", "lang", "datatype", "bnode")


def _cell_sql(column: str, kind: str) -> str:
    """The six fields of a cell, of which its kind of term has some."""
    have = {
        "uri": {"uri": f"substr({column}, 2, length({column}) - 2)", "display": _named(column)},
        "literal": {
            "value": _UNESCAPED.format(column),
            "lang": f"""nullif(regexp_extract({column}, '"@([a-z-]+)$', 1), '')""",
            "datatype": f"""nullif(regexp_extract({column}, '"\\^\\^<([^<>"]*)>$', 1), '')""",
        },
        "bnode": {"bnode": f"substr({column}, 3)"},
    }[kind]
    return ", ".join(f"{have.get(f, 'NULL::VARCHAR')} AS {column}_{f}" for f in _DECORATED)


def _cells(df: DataFrame) -> DataFrame:
    return results.decorate(df, CONFIG).select(*[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in df.columns for f in _DECORATED])


@query("h13_decorated", f"SELECT {_cell_sql('x', 'uri')}, {_cell_sql('l', 'literal')} FROM (SELECT s AS x, o AS l FROM facts WHERE p = '{RDFS_LABEL}')")
def _(g):
    return _cells(found(g, var("x"), [po(RDFS_LABEL, var("l"))]))


@query("h13_decorated_items", f"""SELECT {_cell_sql('x', 'uri')}, {_cell_sql('i', 'bnode')}, {_cell_sql('d', 'literal')}
  FROM (SELECT a.s AS x, a.o AS i, b.o AS d FROM facts a JOIN facts b USING (s) WHERE a.p = '{_p("item")}' AND b.p = '<{testmap.DCT}issued>')""")
def _(g):
    return _cells(found(g, var("x"), [po(_p("item"), var("i")), po(f"<{testmap.DCT}issued>", var("d"))]))


@query("h14_resources_with", f"SELECT DISTINCT s, false AS more FROM facts WHERE p = '{_p('nation')}' AND o = '<{BASE}nation/5>'")
def _(g):
    return browse.resources_with(g, _p("nation"), f"<{BASE}nation/5>")


@query("h14_resources_page", f"SELECT s, total > 13 AS more FROM (SELECT s, count(*) OVER () AS total FROM (SELECT DISTINCT s FROM facts WHERE p = '{_p('nation')}' AND o = '<{BASE}nation/5>')) ORDER BY s LIMIT 10 OFFSET 3")
def _(g):
    return browse.resources_with(g, _p("nation"), f"<{BASE}nation/5>", limit=10, offset=3)


@query("h7_jsonld")
def jsonld(g):
    return documents.export_jsonld(g)


def _said(column: str) -> str:
    """A term, or what a blank node says by its literals and URIs, since names of blank nodes hold within a document."""
    return f"CASE WHEN starts_with({column}, '_:') THEN '_:' || coalesce((SELECT string_agg(DISTINCT p || ' ' || o, ' ' ORDER BY p || ' ' || o) FROM facts f WHERE f.s = x.{column} AND NOT starts_with(f.o, '_:')), '') ELSE {column} END AS {column}"


@query("h7_jsonld_triples", f"SELECT page, {_said('s')}, p, {_said('o')} FROM ({_LOOKUP}) x")
def _(g):
    found = stored(read_jsonld(documents.export_jsonld(g)))
    said = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("o").startswith("_:"), F.concat_ws(" ", "p", "o")))), " ")
    names = stored(found.where("startswith(s, '_:')").groupBy("page", "part", F.col("s").alias("node")).agg(said.alias("said")))
    for c in ("s", "o"):
        found = found.join(names.withColumnsRenamed({"node": c, "said": f"{c}_said"}), ["page", "part", c], "left")
    return found.select("page", *[F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), F.coalesce(f"{c}_said", F.lit("")))).otherwise(F.col(c)).alias(c) for c in ("s", "o")], "p")


@query("r1_tag_labels", f"""SELECT s, p, CASE WHEN p = '{RDFS_LABEL}' AND ends_with(o, '"') THEN replace(o, '\\u', 'u') || '@' || substr(s, 24, 2) ELSE o END AS o FROM facts
  UNION ALL SELECT s, '{rewrite.LANGUAGE}', '"' || substr(s, 24, 2) || '"' FROM facts WHERE p = '{RDFS_LABEL}' AND ends_with(o, '"')""")
def _(g):
    return rewrite.tag_labels(g.facts.select("s", "p", "o"), BASE)


@query("r2_cut_reference", f"""WITH r AS (SELECT s, split_part(o, '#', 1) || '>' AS d FROM facts WHERE p = '{_p("account")}')
  SELECT s, p, CASE WHEN p = '{_p("account")}' THEN split_part(o, '#', 1) || '>' ELSE o END AS o FROM facts
  UNION ALL SELECT DISTINCT d, '{RDFS_LABEL}', '"' || replace(regexp_extract(d, '([^/>]*)>$', 1), '_', ' ') || '"@en' FROM r""".replace("WITH r AS", ", r AS"))
def _(g):
    return rewrite.cut_reference(g.facts, _p("account"))


@query("a10_bound_query", "SELECT p, count(*) AS cnt FROM facts WHERE starts_with(s, '<http://localhost:8080/part/') GROUP BY p HAVING count(*) >= 5")
def _(g):
    text = "SELECT p, count(*) AS cnt FROM {facts} WHERE startswith(s, :prefix) GROUP BY p HAVING count(*) >= :least"
    return tables.query(g.facts.sparkSession, text, {"prefix": f"<{BASE}part/", "least": 5}, facts=g.facts)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their label and nation, in order."""
    g = testmap.graph(spark, sf_dir)
    return found(g, var("c"), [po(RDFS_LABEL, var("l")), po(_p("nation"), var("n")), po(_p("account"), var("a"))]).select("c", "l", "n").orderBy("c")
