"""Terms, sources, load rules, patterns, browse operators, exports and rewrites on small hand-made data."""

import gzip
import json
import random
from dataclasses import replace
from datetime import date
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkedframe import queries
from linkedframe.config import RDF_TYPE, RDFS_LABEL, Config, Facet
from linkedframe.functions import terms as T
from linkedframe.operators import browse, documents, rewrite, stats
from linkedframe.operators.pattern import check_limit, count_by, either, exists, match, nested, optional, page_of_results, po, var, variables
from linkedframe.plans.graph import Graph
from linkedframe.sources import jsonld, ntriples, results, tables

SF = "/root/testdata/sf0.001"
B = "http://localhost:8080/"
DC = "http://purl.org/dc/elements/1.1/"
SEE = "<http://www.w3.org/2000/01/rdf-schema#seeAlso>"
CFG = Config(
    labels=(RDFS_LABEL, f"<{DC}title>"),
    facets=(RDFS_LABEL, f"<{DC}language>"),
    linked_sets=("http://dbpedia.org/",),
    not_linked=("http://www.w3.org/",),
    no_inverse=(f"{B}ontology",),
)
EXAMPLE = [
    (f"<{B}town/lindau>", RDFS_LABEL, '"Seestadt"@de'),
    (f"<{B}town/lindau>", RDFS_LABEL, '"Town by the lake"@en'),
    (f"<{B}town/lindau>", f"<{B}ontology#link>", f"<{B}town/bregenz>"),
    (f"<{B}town/lindau>", SEE, "<http://dbpedia.org/resource/Example>"),
    (f"<{B}town/bregenz>", RDFS_LABEL, '"Seestadt"@de'),
    (f"<{B}town/bregenz>", f"<{DC}creator>", f"<{B}town/bregenz#mayor>"),
    (f"<{B}town/bregenz#mayor>", f"<{DC}title>", '"Ada Quill"'),
    (f"<{B}town/bregenz>", f"<{DC}language>", '"German"'),
    (f"<{B}town/färja..nn.1>", RDFS_LABEL, '"färja ☺ ✓"@sv'),
    (f"<{B}town/bregenz>", f"<{B}ontology#part>", "_:b1"),
    ("_:b1", f"<{B}ontology#next>", "_:b2"),
    ("_:b2", f"<{B}ontology#next>", "_:b1"),
    ("<http://other.org/x>", SEE, f"<{B}town/lindau>"),
    ("<http://other.org/x>", SEE, "<http://other.org/y>"),
    (f"<{B}town/lindau>", RDF_TYPE, f"<{B}ontology#Thing>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, s string, p string, o string")


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.load(frame(spark, EXAMPLE), CFG)


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


# terms


@pytest.mark.parametrize(
    ("n3", "kind", "value", "lang", "datatype"),
    [
        ("<http://x/y>", "uri", "http://x/y", None, None),
        ("_:b", "bnode", "b", None, None),
        ('""', "literal", "", None, None),
        ('"a ^^ \\"@ b"@DE', "literal", 'a ^^ "@ b', "de", None),
        ('"2014"^^<http://t#x>', "literal", "2014", None, "http://t#x"),
        ('"l1\\nl2\\t\\\\ \\u00fc \\uD83D\\uDE00 \\U0001F600 \\uZZZZ \\uD83D"', "literal", "l1\nl2\t\\ ü 😀 😀 \\uZZZZ \\uD83D", None, None),
    ],
)
def test_term_parts(spark, n3, kind, value, lang, datatype):
    r = one(spark, T.term("n3"), n3=n3)
    assert (r["type"], r["value"], r["lang"], r["datatype"]) == (kind, value, lang, datatype)
    again = one(spark, T.to_n3(T.term_type("n3"), T.term_value("n3"), T.term_lang("n3"), T.term_datatype("n3")), n3=n3)
    assert one(spark, T.term_value("n3"), n3=again) == value


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (T.unescape_unicode, "m\\u00fcll \\n", "müll \\n"),
        (T.literal_display, "a\\nb\\\\c\\\"", 'a\nb\\c"'),
        (T.safe_uri, "http://x/Entry-Ag%3Fe+de+aqua", "http://x/Entry-Ag%3Fe+de+aqua"),
        (T.safe_uri, "http://x/f%C3%A4rjel%C3%A4ge..nn.1", "http://x/färjeläge..nn.1"),
        (T.safe_uri, "http://x/a b%zz", "http://x/a+b%zz"),
        (T.safe_uri, 'http://x/"{a}"%2F%41', "http://x/%22%7Ba%7D%22%2FA"),
        (T.safe_path, 'a "b"', "a+%22b%22"),
        (T.strip_format_suffix, "page.rdf", "page"),
        (T.main_of, "<http://x#y>", "<http://x>"),
        (T.main_of, '"a#b"', '"a#b"'),
        (T.fragment_of, "http://x#y", "y"),
        (T.magic_string, "camelCase_and%20more", "Camel Case and more"),
        (T.magic_string, "", ""),
        (T.clean_uri, "a\tb c\xa0d", "abcd"),
        (T.uri_encode, "a b", "a+b"),
        (T.clip, "x" * 200, "x" * 100),
        (T.tokenize, "An ENGLISH test-case Ärlig", ["an", "english", "test", "case", "Ärlig"]),
        (T.native_integer, f'"3"^^<{T.XSD}integer>', 3),
        (T.native_integer, f'"x"^^<{T.XSD}integer>', None),
        (T.native_double, f'"1.5"^^<{T.XSD}double>', 1.5),
        (T.native_date, f'"2014-01-31"^^<{T.XSD}date>', date(2014, 1, 31)),
    ],
)
def test_functions(spark, function, given, expected):
    assert one(spark, function("x"), x=given) == expected


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("x" * 1_000_000, "x" * 1_000_000),
        ('\\"' * 500_000, '"' * 500_000),
        ("\\u00e9" * 100_000, "é" * 100_000),
        ("\\uD83D\\uDE00" * 50_000, "😀" * 50_000),
        ("\\U0001F600 " * 50_000, "😀 " * 50_000),
        ("\\u00e9x" * 50_000, "éx" * 50_000),
        ('"@de ' * 100_000, None),
    ],
)
def test_long_literals(spark, text, value):
    line = f'<http://a> <http://p> "{text}"@en .'
    lines = spark.createDataFrame([(0, line)], "seq long, value string")
    found = ntriples.parse_lines(lines, "permissive").select("_corrupt", T.term_value("o").alias("v"), T.literal_display(F.lit(text)).alias("shown")).first()
    if value is None:  # quotation marks inside
        assert found["_corrupt"] == line
    else:
        assert found["v"] == found["shown"] == value
    assert len(one(spark, T.safe_uri("x"), x="http://x/" + "é%41 " * 50_000)) > 100_000


def test_configured_functions(spark):
    cfg = replace(CFG, prefixes={"ex": "http://ex.org/"}, prop_names={"http://forced/": "Forced"})
    assert one(spark, T.page_of("x", cfg), x=f"{B}test#test") == "test"
    assert one(spark, T.name("p", "f", cfg), p="test", f="test") == f"<{B}test#test>"
    assert one(spark, T.name("p", "f", cfg), p="<BLANK>", f="z") == "_:z"
    for uri, plain, pretty in (
        ("http://forced/", "Forced", "Forced"),
        ("http://ex.org/fooBar", "ex:fooBar", "Foo Bar"),
        (f"{B}a_b", "a_b", "A b"),
        ("http://www.w3.org/2000/01/rdf-schema#seeAlso", "seeAlso", "See Also"),
        ("http://www.w3.org/ns/dcat#Dataset", "dcat:Dataset", "Dataset"),
        ("http://none/", "http://none/", "http://none/"),
        (B, B, B),
    ):
        assert one(spark, T.display_default("x", cfg), x=uri) == plain
        assert one(spark, T.display_pretty("x", cfg), x=uri) == pretty
    assert one(spark, T.display_node("x", cfg), x="_:b") == ""
    assert one(spark, T.display_node("x", Config(display=lambda u, label: F.upper(u))), x="<http://a>") == "HTTP://A"
    assert tuple(one(spark, T.compact("x", cfg), x="http://ex.org/a")) == ("ex", "a")
    assert tuple(one(spark, T.compact("x", cfg), x=f"{B}a")) == (None, "a")
    assert one(spark, T.short_name("x", cfg), x="http://ex.org/a#b") == "b"
    assert one(spark, T.short_name("x", cfg), x="http://ex.org/a-b") == "a-b"
    for uri, target in (("http://dbpedia.org/resource/X", "http://dbpedia.org/"), ("https://a.org:8/x", "https://a.org:8/"), ("http://www.w3.org/x", None), (f"{B}x", None), ("ftp://a/", None)):
        assert one(spark, T.link_target("x", cfg), x=uri) == target
    assert T.expand("ex:a", cfg.all_prefixes) == "http://ex.org/a"
    assert one(spark, T.expand_column("x", cfg.all_prefixes), x="ex:a") == "http://ex.org/a"
    with pytest.raises(ValueError):
        T.expand("no:a", cfg.all_prefixes)


# sources


LINES = [r'<http://a> <http://p> "x \"y\" . \\ ü"@EN .', "", "# note", "_:b <http://p> <http://c> .", "junk", '<http://a> <http://p> "1"^^<http://t> .']


def test_ntriples_modes(spark, tmp_path):
    path = tmp_path / "a.nt.gz"
    path.write_bytes(gzip.compress("\n".join(LINES).encode()))
    good = ntriples.read_ntriples(spark, str(path), "dropmalformed").orderBy("seq")
    assert [tuple(r)[1:] for r in good.collect()] == [("<http://a>", "<http://p>", '"x \\"y\\" . \\\\ ü"@en'), ("_:b", "<http://p>", "<http://c>"), ("<http://a>", "<http://p>", '"1"^^<http://t>')]
    loose = ntriples.read_ntriples(spark, str(path), "permissive")
    assert [r["_corrupt"] for r in loose.where("_corrupt IS NOT NULL").collect()] == ["junk"]
    with pytest.raises(Exception, match="malformed line"):
        ntriples.read_ntriples(spark, str(path)).collect()
    with pytest.raises(ValueError):
        ntriples.read_ntriples(spark, str(path), "other")


def test_ntriples_round_trip(spark, tmp_path):
    odd = [("<http://a>", "<http://p>", o) for o in (f'"{"y" * 100_000}"', f'"{"z" * 9}{chr(92)}{chr(34)}"', '"a ^^ \\"@ b"@de', '"x\\ny\\r\\\\"', '"☺ 😀"', '""^^<http://t>', "_:b")]
    facts = frame(spark, EXAMPLE + odd)
    ntriples.write_ntriples(facts, str(tmp_path / "out"))
    assert rows(ntriples.read_ntriples(spark, str(tmp_path / "out")), "s", "p", "o") == rows(facts, "s", "p", "o")


def test_source_order_decides_labels(spark, tmp_path):
    (tmp_path / "1.nt").write_text(f'<{B}x> {RDFS_LABEL} "z" .\n<{B}x> {RDFS_LABEL} "first" .\n')
    (tmp_path / "2.nt").write_text(f'<{B}x> {RDFS_LABEL} "m" .\n<{B}x> {RDFS_LABEL} "a" .\n')
    graph = Graph.load(ntriples.read_ntriples(spark, str(tmp_path)))
    assert rows(graph.labels) == [(f"<{B}x>", "a")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', None), (2, None, 5)], "id int, name string, n int")
    mapped = [tables.Mapped("name", "http://p/name", lang="EN"), tables.Mapped("n", "http://p/n", uri="http://n/{}")]
    assert rows(tables.triplify(df, "http://x/{id}", mapped)) == [("<http://x/1>", "<http://p/name>", '"a\\"b"@en'), ("<http://x/2>", "<http://p/n>", "<http://n/5>")]
    tables.rows_to_table(spark, [(1, "a")], "id int, name string", str(tmp_path / "t"))
    tables.rows_to_table(spark, [(2, "b")], "id int, name string", str(tmp_path / "t"))
    assert rows(tables.query(spark, "SELECT name FROM {t} WHERE id = :id", {"id": 2}, t=spark.read.parquet(str(tmp_path / "t")))) == [("b",)]
    assert rows(tables.query(spark, "SELECT 1 AS x")) == [(1,)]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, f"name {i}", i * 0.5, date(2024, 1, 1 + i % 28)) for i in range(100)], "id int, name string, x double, day date")
    tables.write_jdbc(df, url, "things", batch=7)
    tables.write_jdbc(df.where("id < 3"), url, "things")
    found = tables.read_jdbc(spark, url, "things", "id long, name string, x double, day date", key="id", bounds=(0, 100), parts=4)
    assert found.schema["id"].dataType.simpleString() == "bigint" and found.rdd.getNumPartitions() == 4
    assert rows(found, "id", "name", "x", "day") == sorted([tuple(r) for r in df.collect()] + [tuple(r) for r in df.where("id < 3").collect()], key=repr)
    assert tables.read_jdbc(spark, url, "things", "x double").where("id = 5").first()["x"] == 2.5


# load rules


def test_load_rules(graph):
    found = {(r["s"], r["p"], r["o"], r["direction"]): (r["page"], r["head"]) for r in graph.page_rows.collect()}
    e = [tuple(x) for x in EXAMPLE]
    assert found[(*e[0], "forward")] == ("town/lindau", True)
    assert found[(*e[6], "forward")] == ("town/bregenz", False)
    assert found[(*e[2], "inverse")] == ("town/bregenz", False)
    assert found[(*e[12], "inverse")] == ("town/lindau", False)
    assert (*e[12], "forward") not in found and not any(k[:3] == e[13] for k in found)
    assert found[(*e[10], "blank")] == ("<BLANK>", False)
    assert (*e[14], "inverse") not in found  # objects in the ontology get no backlinks
    assert graph.facts.count() == len(EXAMPLE) - 1
    assert Graph.load(graph.source.union(graph.source), CFG, dedupe=True).facts.count() == graph.facts.count()
    assert dict(rows(graph.labels))[f"<{B}town/lindau>"] == "Town by the lake"
    assert rows(graph.linksets) == [("http://dbpedia.org/", 1)]
    assert (RDFS_LABEL, '"Seestadt"@de', None, 2) in rows(graph.value_counts)
    assert {r["n3"] for r in graph.terms.collect()} == {x for t in graph.facts.select("s", "p", "o").collect() for x in t}


def test_save_and_open(spark, graph, tmp_path):
    graph.save(str(tmp_path / "g"))
    again = Graph.open(spark, str(tmp_path / "g"), CFG)
    for name in ("labels", "terms", "value_counts", "linksets"):
        assert rows(getattr(again, name)) == rows(getattr(graph, name))
    assert again.facts.count() == graph.facts.count() and rows(browse.search(again, "lake")) == rows(browse.search(graph, "lake"))
    pattern = [po(RDFS_LABEL, var("l")), optional(po(f"<{DC}language>", var("n")))]
    found = match(again.facts, var("s"), pattern)
    assert rows(found) == rows(match(graph.facts, var("s"), pattern)) != []
    for df in (found, browse.summarize(again), browse.list_resources(again, RDFS_LABEL), browse.class_of(again)):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "p_bucket" in x and "FileScan" in x]
        assert scans and not any("PartitionFilters: []" in x for x in scans)
    assert rows(browse.summarize(again)) == rows(browse.summarize(graph)) and rows(browse.class_of(again)) == rows(browse.class_of(graph))


def test_counts_and_decoded(spark, graph, tmp_path):
    saved = graph.save(str(tmp_path / "g"))
    assert dict(rows(saved.property_counts))[RDFS_LABEL] == 4 == saved.counts_of([RDFS_LABEL, "<http://none>"])[RDFS_LABEL]
    assert rows(saved.decoded().drop("seq")) == rows(graph.decoded().drop("seq"))
    plan = saved.decoded()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p#" not in plan


# patterns

FOO, BAR, BAZ = "<http://foo>", "<http://bar>", "<http://baz>"
SMALL = [("a", "foo", "x"), ("a", "bar", "y"), ("b", "foo", "x"), ("b", "foo", "y"), ("b", "baz", "a"), ("c", "foo", "c"), ("c", "bar", "x")]


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, [(f"<{s}>", f"<http://{p}>", f"<{o}>") for s, p, o in SMALL])


def n(*names):
    return tuple(x and f"<{x}>" for x in names)


def test_patterns(small):
    v, w = var("v"), var("w")
    assert rows(match(small, v, [po(FOO, "<y>")])) == [n("b")]
    assert rows(match(small, "<a>", [po(BAR, v)])) == [n("y")]
    assert rows(match(small, v, [po(FOO, v)])) == [n("c")]
    assert rows(match(small, v, [po(FOO, w), po(BAR, w)])) == []
    assert rows(match(small, v, [po(FOO, "<x>", "<y>")])) == [n("b")]
    assert rows(match(small, v, [po(BAZ, nested([po(BAR, w)]))])) == [n("b", "y")]
    assert rows(match(small, None, [po(BAZ, nested([po(BAR, w)]))])) == [n("y")]
    assert rows(match(small, v, [po(FOO, "<x>"), optional(po(BAZ, w))])) == sorted([n("a", None), n("b", "a")], key=repr)
    assert rows(match(small, v, [po(FOO, "<x>"), optional(po(BAZ, w), strict=True)])) == [n("b", "a")]
    assert rows(match(small, v, [either(po(BAR, w), po(BAZ, w))])) == [n("a", "y"), n("b", "a"), n("c", "x")]
    assert rows(match(small, v, [either(po(FOO, "<x>", "<y>"), po(FOO, "<c>"))])) == [n("b"), n("c")]
    assert rows(match(small, v, [either(po(FOO, "<x>"), po(FOO, "<x>"))])) == [n("a"), n("a"), n("b"), n("b")]
    assert rows(match(small, v, [optional(po(BAZ, w))])) == sorted([n("a", None), n("b", "a"), n("c", None)], key=repr)
    assert rows(match(small, v, [po(FOO, w), po(BAR, var("u"))], counts={FOO: 4, BAR: 2})) == [n("a", "x", "y"), n("c", "c", "x")]
    assert match(small, v, [po(FOO, w), po(BAZ, nested([po(BAR, var("u"))]))]).columns == ["v", "w", "u"]
    assert variables([po(FOO, w), optional(either(po(BAR, v), po(BAZ, v)))]) == ["w", "v"]
    assert rows(match(small, v, [po("x:foo", "x:y", prefixes={"x": "http://"})])) == []


def test_pattern_errors(small):
    v, w = var("v"), var("w")
    for bad in (
        lambda: either(po(FOO, v), po(BAR, w)),
        lambda: either(po(FOO, v)),
        lambda: po(FOO),
        lambda: po("no:x", v),
        lambda: match(small, v, []),
        lambda: match(small, v, [po(FOO, v), optional(po(BAR, w)), optional(po(BAZ, w))]),
        lambda: check_limit(None, 1000),
        lambda: check_limit(1000, 1000),
    ):
        with pytest.raises(ValueError):
            bad()
    assert check_limit(10, 1000) == 10 and check_limit(None, -1) == -1


def test_counts_and_pages(small):
    found = match(small, var("v"), [po(FOO, var("w"))])
    assert rows(count_by(found)) == [(4,)]
    assert rows(count_by(found, "w")) == [("<c>", 1), ("<x>", 2), ("<y>", 1)]
    ordered = found.orderBy("v", "w")
    first, more = page_of_results(ordered, 3)
    assert [r["v"] for r in first] == ["<a>", "<b>", "<b>"] and more
    assert page_of_results(ordered, 3, 1)[1] is False
    assert exists(found) and not exists(found.where("v = 'none'"))


# browse


def test_lookup_and_closure(graph, spark):
    pages = spark.createDataFrame([("town/bregenz",), ("none",)], "page string")
    found = {(r["s"], r["o"]) for r in browse.lookup(graph, pages).collect()}
    assert ("_:b1", "_:b2") in found and ("_:b2", "_:b1") in found
    assert (f"<{B}town/lindau>", f"<{B}town/bregenz>") in found
    assert len(found) == 8
    assert browse.closure(graph, graph.page_rows.select("page", F.col("o").alias("node")).limit(0)).count() == 0


def chain(n, cycle=False):
    """A page that holds the first of ``n`` blank nodes, each of which has a value and the next."""
    links = [(f"_:c{i}", f"<{B}next>", f"_:c{i + 1}") for i in range(n - 1)] + ([(f"_:c{n - 1}", f"<{B}next>", "_:c0")] if cycle else [])
    return [(f"<{B}list>", f"<{B}first>", "_:c0"), *links, *[(f"_:c{i}", f"<{B}value>", f'"{i}"') for i in range(n)]]


@pytest.mark.parametrize(("n", "cycle"), [(1, False), (2, True), (100, False), (1000, False), (300, True)])
def test_closure_of_long_chains(spark, n, cycle):
    triples = chain(n, cycle) + [("_:other", f"<{B}next>", "_:c0")]  # not reached
    g = Graph.load(frame(spark, triples), CFG)
    found = browse.lookup(g).where("page = 'list'").select("s", "p", "o")
    assert rows(found) == sorted(chain(n, cycle), key=repr)
    documents_ = documents.export_jsonld(g, spark.createDataFrame([("list",)], "page string"))
    again = rows(jsonld.read_jsonld(documents_), "s", "p", "o")
    assert len(again) == len(chain(n, cycle)) and sum(o.startswith('"') for _, _, o in again) == n


def test_closure_by_brute_force(spark):
    r = random.Random(3)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(90)} | {(0, i) for i in range(1, 40)} | {(i, 59) for i in range(1, 40)}
    triples = [(f"_:n{a}", f"<{B}to>", f"_:n{b}") for a, b in edges]
    starts = {(f"p{i}", r.randrange(60)) for i in range(12)}
    want = set()
    for page, node in starts:
        seen, waiting = {node}, [node]
        while waiting:
            a = waiting.pop()
            new = {y for x, y in edges if x == a} - seen
            seen |= new
            waiting += new
        want |= {(page, f"_:n{a}", f"_:n{b}") for a, b in edges if a in seen}
    g = Graph.load(frame(spark, triples), CFG)
    found = browse.closure(g, spark.createDataFrame([(p, f"_:n{n}") for p, n in starts], "page string, node string"))
    assert {(x["page"], x["s"], x["o"]) for x in found.collect()} == want and found.count() == len(want)


def test_facets_have_names(spark, graph):
    cfg = replace(CFG, facets=(Facet(RDFS_LABEL, "Name"), Facet(f"<{DC}language>", listed=False), SEE))
    panel = browse.facet_panel(Graph(graph.facts, graph.page_rows, cfg, graph.source)).collect()
    assert {(r["p"], r["name"]) for r in panel} == {(RDFS_LABEL, "Name"), (SEE, "See Also")}


def test_resources_by_pages(spark):
    g = Graph.load(frame(spark, [(f"<{B}r{i:02d}>", f"<{B}p>", '"v"') for i in range(25)]), CFG)
    assert browse.resources_with(g, f"<{B}p>", '"v"').count() == 25
    first = browse.resources_with(g, f"<{B}p>", '"v"', limit=10, offset=5).collect()
    assert [r["s"] for r in first] == [f"<{B}r{i:02d}>" for i in range(5, 15)] and all(r["more"] for r in first)
    assert not any(r["more"] for r in browse.resources_with(g, f"<{B}p>", '"v"', limit=10, offset=15).collect())


def test_browse(graph, spark):
    assert len(rows(browse.summarize(graph))) == 5
    assert len(rows(browse.summarize(graph, n=1))) == 3
    listed = dict(rows(browse.list_resources(graph)))
    assert listed["town/lindau"] == "Town by the lake" and "town/bregenz" in listed
    assert rows(browse.list_resources(graph, f"<{DC}language>", '"German"'), "page") == [("town/bregenz",)]
    with pytest.raises(ValueError):
        browse.list_resources(graph, value="x")
    assert [tuple(r) for r in browse.list_values(graph, RDFS_LABEL, 1).collect()] == [('"Seestadt"@de', "Seestadt", 2)]
    panel = browse.facet_panel(graph, 2).collect()
    assert {(r["p"], r["more"]) for r in panel} == {(RDFS_LABEL, True), (f"<{DC}language>", False)}
    pages = spark.createDataFrame([("town/bregenz",), ("none",)], "page string")
    assert dict(rows(browse.label_of(graph, pages))) == {"town/bregenz": "Seestadt", "none": None}
    assert rows(browse.class_of(graph)) == [("town/lindau", f"<{B}ontology#Thing>")]
    assert dict(rows(browse.titles(graph)))["town/lindau"] == "Seestadt, Town by the lake"
    assert rows(browse.resources_with(graph, RDFS_LABEL, '"Seestadt"@de'), "s") == [(f"<{B}town/bregenz>",), (f"<{B}town/lindau>",)]


DOCS = ["English example", "An ENGLISH test-case", "gata Ärlig", "ärlig", "http://localhost:8080/data/examples", "exampl english longer example"]


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [
        ({"query": ""}, []),
        ({"query": "English"}, [0, 1, 5]),
        ({"query": "english example"}, [0, 5]),
        ({"query": "test"}, [1]),
        ({"query": "ärlig"}, [3]),
        ({"query": "Ärlig"}, [2]),
        ({"prefix": "exam"}, [0, 5, 4]),
        ({"phrase": "english example"}, [0]),
        ({"any_of": "english ärlig"}, [3, 0, 1, 5]),
        ({"query": "english", "none_of": "example"}, [1]),
        ({"query": "data"}, [4]),
        ({"none_of": "data"}, []),
        ({"query": "english", "limit": 1, "offset": 1}, [1]),
    ],
)
def test_search(spark, arguments, expected):
    g = Graph.load(frame(spark, [(f"<{B}{i}>", f"<{DC}title2>", f'"{t}"') for i, t in enumerate(DOCS)]), CFG)
    found = browse.search(g, **arguments).orderBy("doc_len", "main").collect()
    assert [int(r["main"][len(B) + 1 : -1]) for r in found] == expected


def test_description(graph):
    cfg = replace(CFG, publisher=("P", "p@x"), creators=(("C", ""),), contributors=(("D", "d@x"),), issued="2014-01-31", keywords=("k",), description='a "b"', rights="http://r", derived_from=("http://d",), ontology="o", version="1")
    found = rows(stats.describe_dataset(Graph(graph.facts, graph.page_rows, cfg, graph.source)))
    about = f"<{B}description>"
    void = "http://rdfs.org/ns/void#"
    assert (about, f"<{void}triples>", f'"14"^^<{T.XSD}integer>') in found
    assert (f"<{B}description#LinkSet-1>", f"<{void}target>", "<http://dbpedia.org/>") in found
    assert (about, f"<{DC}contributor>", f"<{B}description#Contributor-1>") in found
    assert (f"<{B}description#Publisher>", "<http://xmlns.com/foaf/0.1/mbox>", '"p@x"') in found
    assert (about, f"<{void}exampleResource>", f"<{B}town/bregenz>") in found
    assert not any(o == '""' for _, _, o in found)


# documents


def tree(spark, triples, prefixes=None):
    cfg = Config(prefixes=prefixes or {})
    g = Graph.load(frame(spark, triples), cfg)
    pages = spark.createDataFrame([("foo",)], "page string")
    return json.loads(documents.export_jsonld(g, pages).first()["document"])


EX = "http://www.example.com/"
ME = f"<{B}foo>"


def test_jsonld(spark):
    base = {"@base": B}
    assert tree(spark, [(ME, f"<{EX}bar>", '"foo"@en')]) == {"@context": base | {"bar": EX + "bar"}, "@id": "foo", "bar": {"@value": "foo", "@language": "en"}}
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    assert tree(spark, [(ME, f"<{EX}list>", "_:b"), ("_:b", f"<{EX}first>", f"<{EX}value>"), ("_:b", f"<{EX}rest>", f"<{rdf}nil>")]) == {
        "@context": base | {x: {"@id": EX + x, "@type": "@id"} for x in ("list", "first", "rest")} | {"rdf": rdf},
        "@id": "foo",
        "list": {"first": EX + "value", "rest": "rdf:nil"},
    }
    assert tree(spark, [(ME, f"<{EX}prop>", '"foo"'), (f"<{EX}bar>", f"<{EX}backLink>", ME)]) == {
        "@context": base | {"prop": EX + "prop", "backLink": {"@id": EX + "backLink", "@type": "@id"}},
        "@id": "foo",
        "prop": "foo",
        "@reverse": {"backLink": {"@id": EX + "bar"}},
    }
    many = [(ME, f"<{EX}mp>", '"foo"@en'), (ME, f"<{EX}mp>", f"<{EX}bar>"), (ME, f"<{EX}op>", f"<{B}foo#baz>"), (ME, f"<{EX}op>", f"<{EX}bar>"), (ME, f"<{EX}dp>", f'"bar"^^<{EX}type>'), (ME, f"<{EX}dp>", '"baz"')]
    found = tree(spark, many)
    assert found["mp"] == [{"@value": "foo", "@language": "en"}, {"@id": EX + "bar"}]
    assert sorted(found["op"]) == ["foo#baz", EX + "bar"]
    assert found["dp"] == [{"@value": "bar", "@type": EX + "type"}, "baz"]
    shared = tree(spark, [(ME, f"<{EX}prop1>", "_:bar"), (ME, f"<{EX}prop2>", "_:bar")])
    assert shared["prop1"] == shared["prop2"] == "_:bar"
    apart = tree(spark, [(ME, f"<{EX}prop>", '"foo"@en'), (f"<{B}foo#typo>", f"<{EX}prop>", '"bar"@en')])
    assert apart["@graph"] == [{"@id": "foo", "prop": {"@value": "foo", "@language": "en"}}, {"@id": "foo#typo", "prop": {"@value": "bar", "@language": "en"}}]
    assert tree(spark, [(ME, f"<{rdf}type>", f"<{EX}Bar>")])["@type"] == EX + "Bar"
    number = tree(spark, [(ME, f"<{EX}foo>", f'"3"^^<{T.XSD}integer>'), (ME, f"<{EX}x>", f'"1.5e2"^^<{T.XSD}double>'), (ME, f"<{EX}y>", f'"z"^^<{T.XSD}integer>')])
    assert number["foo"] == 3 and number["x"] == {"@value": "1.5e2", "@type": T.XSD + "double"} and number["y"] == {"@value": "z", "@type": T.XSD + "integer"}
    assert tree(spark, [(ME, f"<{EX}a#n>", '"1"'), (ME, f"<{EX}b#n>", '"2"')])["n2"] == "2"


def blank_names(triples):
    """Triples with blank nodes told apart by what they say, as far as three steps reach."""
    names = {x: "_:" for t in triples for x in (t[0], t[2]) if x.startswith("_:")}
    for _ in range(3):
        names = {n: "_:" + repr(sorted((p, names.get(o, o)) for s, p, o in triples if s == n)) for n in names}
    return sorted((names.get(s, s), p, names.get(o, o)) for s, p, o in triples)


def test_jsonld_reads_back(spark):
    """Documents of tangled pages say just what the pages do."""
    r = random.Random(6)
    nodes = [ME, *[f"<{B}foo#{i}>" for i in range(8)], *[f"_:b{i}" for i in range(8)], f"<{EX}far>", f"<{B}a:b>"]
    values = ['"v"', '"v"@en', f'"7"^^<{T.XSD}integer>', f'"007"^^<{EX}t>', '"a\\n\\"b\\\\"', f'"1.5"^^<{T.XSD}double>', f'"x"^^<{T.XSD}integer>', f'"{"9" * 5000}"^^<{T.XSD}integer>']
    for _ in range(6):
        triples = sorted({(r.choice(nodes), f"<{EX}{r.choice('pqr')}>", r.choice(nodes)) for _ in range(25)} | {(r.choice(nodes[:17]), f"<{EX}{r.choice('pxy')}>", r.choice(values)) for _ in range(15)} | {(ME, RDF_TYPE, f"<{EX}T>")})
        props = [{"p": p, "all_resources": all(not o.startswith('"') for _, q, o in triples if q == p), "short": p[len(EX) + 1 : -1]} for p in {p for _, p, _ in triples}]
        parts = {v: spark.createDataFrame([(v,)], "o string").select(T.term_value("o"), T.term_lang("o"), T.term_datatype("o")).first() for v in {o for *_, o in triples if o.startswith('"')}}
        given = [{"s": s, "p": p, "o": o, **dict(zip(("value", "lang", "datatype"), parts.get(o, (None,) * 3), strict=True))} for s, p, o in triples]
        for depth in (2, 100):
            before, documents.NESTED = documents.NESTED, depth
            try:
                document = documents.page_document("foo", given, props, ["rdf"], CFG)
            finally:
                documents.NESTED = before
            again = jsonld.triples_of(json.loads(json.dumps(document)))
            assert blank_names(again) == blank_names(triples)


def test_many_linked_fragments(spark):
    links = [(f"<{B}foo#{i}>", f"<{EX}next>", f"<{B}foo#{i + 1}>") for i in range(1500)] + [(ME, f"<{EX}next>", f"<{B}foo#0>")]
    g = Graph.load(frame(spark, links), CFG)
    out = documents.export_jsonld(g, spark.createDataFrame([("foo",)], "page string"))
    assert rows(jsonld.read_jsonld(out), "s", "p", "o") == sorted(links, key=repr)


def test_large_pages_are_dealt_to_parts(spark):
    back = [(f"<{EX}s{i}>", f"<{EX}to>", ME) for i in range(30)]
    own = [(ME, f"<{EX}value>", f'"{i}"') for i in range(20)]
    blank = [(ME, f"<{EX}item>", "_:b"), ("_:b", f"<{EX}name>", '"n"')]
    g = Graph.load(frame(spark, back + own + blank), Config())
    found = documents.export_jsonld(g, size=10).collect()
    trees = [json.loads(r["document"]) for r in found]
    assert 1 < len(found) == len({r["part"] for r in found}) <= 6 and all(set(x) - {"@id", "@reverse", "@context"} <= set(x["@context"]) for x in trees)

    def listed(x):
        return x if isinstance(x, list) else [x]

    assert sorted(y["@id"] for x in trees for y in listed(x.get("@reverse", {}).get("to", []))) == sorted(f"{EX}s{i}" for i in range(30))
    assert sorted(int(y) for x in trees for y in listed(x.get("value", []))) == list(range(20))
    assert [x["item"] for x in trees if "item" in x] == [{"name": "n"}]
    table = documents.page_documents(g, size=10).collect()
    assert len(table) > 1 and len(table) == len({r["part"] for r in table})
    assert sorted(s for r in table for x in r["inverses"] or [] for s in x["subjects"]) == sorted(s for s, _, _ in back)
    assert sorted(v["term"] for r in table for x in r["properties"] or [] for v in x["values"]) == sorted(["_:b", *(o for _, _, o in own)])
    assert [r["part"] for r in documents.page_documents(g).collect()] == [0]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long").repartition(5)
    assert rows(stats.numbered(df, F.desc("x")), "n", "x") == sorted(((i + 1, 100 - i) for i in range(101)), key=repr)
    assert rows(stats.numbered(df.limit(0), F.desc("x"))) == []


def test_page_documents(graph):
    found = {r["s"]: r for r in documents.page_documents(graph).collect()}
    first = found[f"<{B}town/lindau>"]
    assert first["class"] == f"<{B}ontology#Thing>" and first["label"] == "Town by the lake"
    assert [p["display"] for p in first["properties"]] == sorted(p["display"] for p in first["properties"])
    assert not any(p["p"] == RDF_TYPE for p in first["properties"])
    assert first["inverses"][0]["subjects"] == ["<http://other.org/x>"]
    part = next(p for p in found[f"<{B}town/bregenz>"]["properties"] if p["p"].endswith("part>"))
    nested = part["values"][0]["nested"][0]
    assert nested["value"] == "_:b2" and nested["nested"][0]["value"] == "_:b1"


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("<http://www.example.org>", '"foo"', '"foo"@en'), ("_:bar", None, '"f<o"^^<http://www.w3.org/2001/XMLSchema#string>')], "a string, b string, c string")
    found = json.loads(results.bindings_json(df))
    assert found["head"] == {"vars": ["a", "b", "c"]}
    assert found["results"]["bindings"] == [
        {"a": {"type": "uri", "value": "http://www.example.org"}, "b": {"type": "literal", "value": "foo"}, "c": {"type": "literal", "value": "foo", "xml:lang": "en"}},
        {"a": {"type": "bnode", "value": "bar"}, "c": {"type": "literal", "value": "f<o", "datatype": "http://www.w3.org/2001/XMLSchema#string"}},
    ]
    xml = results.bindings_xml(df)
    assert '<binding name="c"><literal xml:lang="en">foo</literal></binding></result>' in xml
    assert '<result><binding name="a"><bnode>bar</bnode></binding><binding name="c"><literal datatype="http://www.w3.org/2001/XMLSchema#string">f&lt;o</literal>' in xml
    with pytest.raises(ValueError):
        results.bindings_json(df, limit=1)
    results.write_bindings_json(df, str(tmp_path / "j"))
    results.write_bindings_xml(df, str(tmp_path / "x"))
    def whole(name):
        return "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))

    assert json.loads(whole("j")) == found
    marks = {"s": "{http://www.w3.org/2005/sparql-results#}"}
    tree = ElementTree.fromstring(whole("x"))
    assert [v.get("name") for v in tree.iter(marks["s"] + "variable")] == ["a", "b", "c"] and len(list(tree.iter(marks["s"] + "result"))) == 2
    odd = spark.range(2000).selectExpr("concat('\"', id, char(1), '<&\"') as `x<&\"y`").repartition(5)
    results.write_bindings_json(odd, str(tmp_path / "oj"))
    results.write_bindings_xml(odd, str(tmp_path / "ox"))
    assert len(json.loads(whole("oj"))["results"]["bindings"]) == 2000
    tree = ElementTree.fromstring(whole("ox"))
    assert next(tree.iter(marks["s"] + "variable")).get("name") == 'x<&"y' and len(list(tree.iter(marks["s"] + "binding"))) == 2000
    results.write_bindings_json(df.limit(0), str(tmp_path / "e"))
    assert json.loads(whole("e")) == {"head": {"vars": ["a", "b", "c"]}, "results": {"bindings": []}}
    cell = results.decorate(df, CFG).where("a.bnode is null").first()
    assert cell["a"]["uri"] == "http://www.example.org" and cell["c"]["lang"] == "en" and cell["b"]["value"] == "foo"


# rewrites


def test_rewrites(spark):
    emn = "http://data.lider-project.eu/emn/"
    df = frame(spark, [(f"<{emn}de/x>", RDFS_LABEL, '"a\\u00e4"'), (f"<{emn}de/x>", SEE, "<http://y>")])
    assert rows(rewrite.tag_labels(df, emn), "s", "p", "o") == sorted(
        [(f"<{emn}de/x>", RDFS_LABEL, '"au00e4"@de'), (f"<{emn}de/x>", rewrite.LANGUAGE, '"de"'), (f"<{emn}de/x>", SEE, "<http://y>")], key=repr
    )
    tagged = [(f"<{emn}de/x>", RDFS_LABEL, '"a"@en'), (f"<{emn}de/x>", RDFS_LABEL, f'"a"^^<{T.XSD}string>')]  # stay valid terms
    assert rows(rewrite.tag_labels(frame(spark, tagged), emn), "s", "p", "o") == sorted(tagged, key=repr)
    p = rewrite.REFERENCE_CONTEXT
    df = frame(spark, [("<http://1>", p, "<http://d/A_b#c=0,1>"), ("<http://2>", p, "<http://d/A_b#c=2,3>"), ("<http://3>", p, "<http://d/C>"), ("<http://4>", p, "<http://d/A_b#z>"), ("<http://4>", SEE, "<http://q#r>")])
    label = ("<http://d/A_b>", RDFS_LABEL, '"A b"@en')
    for consecutive, times in ((False, 1), (True, 2)):
        found = rows(rewrite.cut_reference(df, consecutive=consecutive))
        assert found.count(label) == times and ("<http://d/C>", RDFS_LABEL, '"C"@en') in found
        assert ("<http://2>", p, "<http://d/A_b>") in found and ("<http://4>", SEE, "<http://q#r>") in found
    many = [(f"<http://{i}>", p, f"<http://d/D{i // 7 % 5}#c>") for i in range(200)]
    found = rows(rewrite.cut_reference(frame(spark, many).repartition(7), consecutive=True))
    changes = [i for i in range(200) if i == 0 or i // 7 % 5 != (i - 1) // 7 % 5]
    assert sum(r[1] == RDFS_LABEL for r in found) == len(changes)
    lines = spark.createDataFrame([("a %5Cu00e4%5CuD83D%5CuDE00 %5Cuzz %41",)], "value string")
    assert rows(rewrite.repair_escapes(lines)) == [("a %C3%A4%F0%9F%98%80 %5Cuzz %41",)]


# contracts


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["c", "l", "n"] and found.count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem pages documents".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


# the rows of h3_list_by_value begin behind the few that this size has
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, con, name):
    found = queries.QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert name == "a5_triplify" or "o_orderdate" not in plan and "l_returnflag" not in plan  # reads the saved graph
    names = sorted(found.columns)
    want = con.sql(f"select {', '.join(names)} from ({queries.ORACLES[name]}) z").fetchall()
    assert (want or name == "h3_list_by_value") and rows(found, *names) == sorted((tuple(r) for r in want), key=repr)


def test_property_filter_prunes_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "id long, x string, y string")
    both = tables.triplify(df, "http://x/{id}", [tables.Mapped("x", "http://p/x"), tables.Mapped("y", "http://p/y")])
    one = both.where("p = '<http://p/x>'")
    assert "Union" in both._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert rows(one) == [("<http://x/1>", "<http://p/x>", '"a"')]
