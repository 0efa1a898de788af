"""What must hold for hot pages, long chains and large results: on small data, with small settings."""

import json
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from linkedframe import queries, storage, testmap
from linkedframe.config import RDFS_NAMESPACES, Config
from linkedframe.functions import terms as T
from linkedframe.operators import browse, documents, pattern, reach
from linkedframe.operators.components import connected
from linkedframe.operators.reach import reached
from linkedframe.operators.pattern import match, optional, po, var
from linkedframe.plans import graph as graph_
from linkedframe.plans.graph import Graph
from linkedframe.plans.positions import Positions
from linkedframe.sources import jsonld, results, tables
from tests.conftest import SF
from tests.test_graph import CFG, EX, ME, B, blank_names, frame


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_results_keep_their_order(spark, tmp_path, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        # eight parts of very unequal size, sorted as a whole
        bound = F.expr("CASE WHEN id < 10 THEN 0 WHEN id < 1500 THEN 1 WHEN id < 1600 THEN 2 WHEN id < 3000 THEN 3 WHEN id < 3010 THEN 4 WHEN id < 3011 THEN 5 WHEN id < 3900 THEN 6 ELSE 7 END")
        df = spark.range(4000).withColumn("k", bound).repartitionByRange(8, "k").sortWithinPartitions("id").select(F.format_string('"%06d"', "id").alias("x"))
        results.write_bindings_json(df, str(tmp_path / "j"))
        results.write_bindings_json(df.orderBy(F.desc("x")), str(tmp_path / "d"))
        results.write_bindings_xml(df, str(tmp_path / "x"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)

    def whole(name):
        return "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))

    want = [f"{i:06d}" for i in range(4000)]
    assert [r["x"]["value"] for r in json.loads(whole("j"))["results"]["bindings"]] == want
    assert [r["x"]["value"] for r in json.loads(whole("d"))["results"]["bindings"]] == want[::-1]
    at = [whole("x").index(f">{v}<") for v in want]
    assert at == sorted(at)


def test_scopes_delete_what_was_stored(spark):
    def tables():
        path = spark._jvm.org.apache.hadoop.fs.Path(storage.shared_folder(spark))
        return {x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}

    before = tables()
    with storage.scope(spark):
        assert storage.stored(spark.range(5)).count() == 5
        with storage.scope(spark):
            storage.stored(spark.range(6))
            assert len(tables() - before) == 2
        assert len(tables() - before) == 1
    assert tables() == before


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (blocks.apply(i).getName() for i in range(blocks.size())) if f.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(storage.CLEANED, None)
    table = storage.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and spark.conf.get(storage.CLEANED, None) == setting
    again = storage.stored(table.where("k > 3"))
    storage.discard(table, spark.range(3))
    assert again.count() == 3 and not storage.exists(spark, table.__dict__["stored_at"])


def test_components_by_brute_force(spark):
    r = random.Random(4)
    for n, m in ((40, 25), (60, 60), (30, 200)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300)]
        links += [(200, 210 + i) for i in range(50)]
        root = {x: x for link in links for x in link}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = connected(spark.createDataFrame(links, "a long, b long")).collect()
        assert dict(got) == {x: find(x) for x in root} and len(got) == len(root)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_pages_are_dealt_by_component(spark):
    """A page whose rows are nearly all of blank nodes is many documents, which together say what the page does."""
    r, triples = random.Random(5), []
    for i in range(120):  # components: chains, cycles, shared nodes
        size = r.randrange(1, 6)
        triples += [(ME, f"<{EX}item>", f"_:c{i}n0"), *[(f"_:c{i}n{k}", f"<{EX}value>", f'"{i} {k}"') for k in range(size)]]
        triples += [(f"_:c{i}n{k}", f"<{EX}next>", f"_:c{i}n{(k + 1) % size}") for k in range(size)] + [(f"_:c{i}n{r.randrange(size)}", f"<{EX}also>", f"_:c{i}n{r.randrange(size)}")]
    triples += [(f"<{EX}s{i}>", f"<{EX}to>", ME) for i in range(150)] + [(ME, f"<{EX}text>", f'"{i}"') for i in range(100)]
    triples = sorted(set(triples))
    g = Graph.load(frame(spark, triples), CFG)
    found = documents.export_jsonld(g, size=50).where("page = 'foo'").collect()
    assert len({x["part"] for x in found}) == len(found) > 15
    said = [jsonld.triples_of(json.loads(x["document"])) for x in found]
    assert max(map(len, said)) < 150
    # by structure: names of blank nodes hold within a document
    assert sorted(t for x in said for t in blank_names(x)) == blank_names(triples)
    assert documents.export_jsonld(g).where("page = 'foo'").count() == 1  # below the default size
    assert documents.SIZE == 10_000


def test_numbers_keep_their_text(spark):
    texts = ["7", "-7", "0", "007", "+5", "-0", "9" * 18, "9" * 19, "1e3", " 7"]
    doubles = ["1.5", "1.10", "-0.25", "1e3", "+1.5", ".5", "1", "1.0", "100000000000000000.0", "0.1"]
    xsd = "http://www.w3.org/2001/XMLSchema#"
    triples = [(ME, f"<{EX}p{i}>", f'"{x}"^^<{xsd}integer>') for i, x in enumerate(texts)] + [(ME, f"<{EX}q{i}>", f'"{x}"^^<{xsd}double>') for i, x in enumerate(doubles)]
    g = Graph.load(frame(spark, triples), Config())
    tree = json.loads(documents.export_jsonld(g).first()["document"])
    assert sorted(jsonld.triples_of(tree)) == sorted(triples)
    assert tree["p0"] == 7 and tree["p1"] == -7 and tree["q0"] == 1.5 and tree["p3"]["@value"] == "007" and tree["q1"]["@value"] == "1.10"


def levels(links, starts):
    """Breadth-first search from each page."""
    after = defaultdict(set)
    for a, b in links:
        after[a].add(b)
    out = {}
    for page in {p for p, _ in starts}:
        now, level, seen = {n for p, n in starts if p == page}, 0, set()
        while now:
            out |= {(page, n): level for n in now}
            seen |= now
            now, level = {b for n in now for b in after[n]} - seen, level + 1
    return out


def reach_of(spark, links, starts):
    g = Graph.load(frame(spark, [(f"_:n{a}", f"<{B}to>", f"_:n{b}") for a, b in links] + [("_:z", f"<{B}to>", '"v"')]), CFG)
    found = reached(g, spark.createDataFrame([(p, f"_:n{n}") for p, n in starts], "page string, node string")).collect()
    assert len({(r["page"], r["node"]) for r in found}) == len(found)
    return {(r["page"], int(r["node"][3:])): r["level"] for r in found}


@pytest.mark.parametrize("widen", [0, 4])
def test_levels_by_brute_force(spark, monkeypatch, widen):
    """With and without doubled steps: chains, circles, hubs, shortcuts and starts within chains."""
    monkeypatch.setattr(reach, "WIDEN", widen)
    r = random.Random(8)
    links = {(r.randrange(40), r.randrange(40)) for _ in range(55)} | {(0, i) for i in range(1, 15)} | {(i, 39) for i in range(1, 15)}
    links |= {(100 + i, 101 + i) for i in range(30)} | {(39, 100), (130, 5)}  # a chain within the tangle
    links |= {(200 + i, 200 + (i + 1) % 7) for i in range(7)} | {(300 + i, 300 + (i + 1) % 5) for i in range(5)}  # circles, one never reached
    starts = {(f"p{i}", r.randrange(40)) for i in range(6)} | {("p0", 110), ("p7", 203), ("p8", 999)}
    assert reach_of(spark, links, starts) == levels(links, starts)


def test_a_chain_behind_a_hub(spark, monkeypatch):
    """Rows written in all rounds stay near the size of the answer, and rounds are few."""
    n, wide = 10_000, 300
    links = {(1, 10 + i) for i in range(wide)} | {(10 + i, 2) for i in range(wide)} | {(2, 1000)} | {(1000 + i, 1001 + i) for i in range(n)}
    written = []

    def counted(df):
        out = storage.stored(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(reach, "stored", counted)
    starts = {("p", 1)}
    assert reach_of(spark, links, starts) == levels(links, starts)
    assert len(written) < 40 and sum(written) < 25 * n  # 15 rounds that draw the chain together, of n rows each


def brute_tree(triples, page="foo"):
    """Rows of a page by breadth-first search; positions by (node, p, o)."""
    root = {s for s, _, _ in triples if s.startswith(f"<{B}{page}")}
    level, now, found = {s: -1 for s in root}, sorted(root), []
    while now:
        found += [(s, p, o) for s, p, o in triples if s in now]
        now = sorted({o for s, _, o in triples if s in now and o.startswith("_:") and o not in level})
        level |= dict.fromkeys(now, max(level.values()) + 1)
    order = sorted(set(found))
    n = {t: i for i, t in enumerate(order)}
    place = {}
    for t in order:
        if t[2].startswith("_:") and level[t[2]] == level[t[0]] + 1:
            place.setdefault(t[2], t)

    def path(t):
        return (*path(place[t[0]]), n[t]) if t[0] in place else (n[t],)

    def top(x):
        return top(place[x][0]) if x in place else x

    return sorted((top(t[0]), path(t), *t, place.get(t[2]) == t) for t in order)


@pytest.mark.parametrize("kind", ["chain", "tangle", "circle"])
def test_property_trees_at_any_depth(spark, kind):
    r = random.Random(2)
    me, part = f"<{B}foo>", f"<{B}foo#x>"
    if kind == "chain":
        triples = [(me, f"<{EX}p>", "_:n0"), *[(f"_:n{i}", f"<{EX}p>", f"_:n{i + 1}") for i in range(90)], *[(f"_:n{i}", f"<{EX}v>", f'"{i}"') for i in range(91)]]
    elif kind == "circle":
        triples = [(me, f"<{EX}p>", f"_:n{i % 3}") for i in range(4)] + [(f"_:n{i}", f"<{EX}q>", f"_:n{(i + 1) % 9}") for i in range(9)] + [(part, f"<{EX}p>", "_:n5"), (part, f"<{EX}p>", "_:n5")]
    else:
        nodes = [me, part, *[f"_:n{i}" for i in range(14)]]
        triples = sorted({(r.choice(nodes), f"<{EX}{r.choice('pq')}>", r.choice(nodes)) for _ in range(40)} | {(r.choice(nodes), f"<{EX}v>", f'"{i}"') for i in range(20)})
    g = Graph.load(frame(spark, triples), CFG)
    found = documents.property_tree(g, spark.createDataFrame([("foo",)], "page string")).collect()
    first = min(x for r in found for x in r["path"])
    assert sorted((r["s"], tuple(x - first for x in r["path"]), r["node"], r["p"], r["o"], r["inside"]) for r in found) == brute_tree(triples)
    assert documents.property_tree(g, spark.createDataFrame([], "page string")).count() == 0


def test_pages_by_position(spark, tmp_path):
    """A page far behind is read from its own range."""
    df = spark.range(12_000_000).withColumn("k", F.expr("12000000 - id"))
    saved = Positions.save(df.select("id", "k"), str(tmp_path / "p"), "k", ranges=24)
    page = saved.page(10_000_000, 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    touched = saved.ranges.where("start <= 10000000 AND start + cnt > 10000000").select("slot").collect()
    assert len(touched) == 1 and "slot#" in plan and plan.count("PartitionFilters: [isnotnull(slot") == 1 and f"= {touched[0]['slot']})" in plan
    assert [r["k"] for r in page.collect()] == [10_000_001 + i for i in range(5)]
    assert saved.total() == 12_000_000 and saved.page(12_000_000, 5).count() == 0 and saved.page(11_999_999).count() == 1


def test_pages_of_ranges(spark, tmp_path):
    rows = [(i % 7, f"v{i:03d}") for i in range(200)] + [(None, "none")]
    for by in (("a", "b"), ("-a", "b")):
        saved = Positions.save(spark.createDataFrame(rows, "a int, b string"), str(tmp_path / "r"), *by, ranges=5)
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]) if by[0] == "a" else (r[0] is None, -(r[0] or 0), r[1]))
        for offset, limit in ((0, 10), (35, 40), (190, 50), (0, None), (77, None), (300, 3), (50, 0)):
            assert [tuple(r) for r in saved.page(offset, limit).collect()] == order[offset:][:limit]
        again = Positions.open(spark, str(tmp_path / "r"), *by)
        assert {r["a"]: (r["start"], r["cnt"]) for r in again.starts("a").collect()} == {a: (min(i for i, r in enumerate(order) if r[0] == a), sum(r[0] == a for r in rows)) for a in {r[0] for r in rows}}
    none = Positions.save(spark.createDataFrame([], "a int, b string"), str(tmp_path / "e"), "a", "b")
    assert none.total() == 0 and none.page(0, 5).count() == 0 and none.page(3).count() == 0


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """A saved graph of 3,000 texts of all lengths, each with the word ``the``."""
    r = random.Random(12)
    texts = [" ".join(["the", *(r.choice(["red", "blue", "old", "new", "house"]) for _ in range(r.randrange(1, 60)))]) for _ in range(3000)]
    triples = [(f"<{B}t{i:04d}>", f"<{EX}text>", f'"{x}"') for i, x in enumerate(texts)] + [(f"<{B}t{i:04d}>", f"<{EX}kind>", f'"{i % 2}"') for i in range(3000)]
    before, graph_.BLOCK = graph_.BLOCK, 64
    try:
        saved = Graph.load(frame(spark, triples), CFG).save(str(tmp_path_factory.mktemp("library") / "g"))
        saved.blocks, saved.listing, saved.group_starts
    finally:
        graph_.BLOCK = before
    return saved


@pytest.mark.parametrize(
    "arguments",
    [{"query": "the"}, {"query": "the house"}, {"phrase": "red house"}, {"any_of": "old new", "none_of": "the"}, {"any_of": "old new", "none_of": "blue"}, {"prefix": "hou"}, {"query": "absent"}, {"query": "the", "prop": f"<{EX}none>"}],
)
def test_first_hits_are_those_of_all(library, arguments):
    for limit, offset in ((20, 0), (7, 30)):
        every = [tuple(r) for r in browse.search(library, **arguments).orderBy("doc_len", "main").collect()]
        assert [tuple(r) for r in browse.search(library, **arguments, limit=limit, offset=offset).collect()] == every[offset : offset + limit]


def test_first_hits_read_few_blocks(library):
    token = F.col("token") == "the"
    whole = library.blocks.where(token).count()
    _, bound = browse.shortest(library, token, [token], lambda rows: rows.groupBy("main").agg(F.min("doc_len").alias("doc_len")), 20)
    read = library.blocks.where(token & (F.col("least") <= bound))
    assert whole >= 40 and read.count() * 8 < whole
    assert "LessThanOrEqual(least" in read._jdf.queryExecution().executedPlan().toString()


def test_saved_lists_by_position(spark, library):
    assert [r["page"] for r in browse.list_resources(library, limit=3, offset=2990).collect()] == ["t2990", "t2991", "t2992"]
    found = browse.resources_with(library, f"<{EX}kind>", '"1"', limit=4, offset=1497).collect()
    assert [r["s"] for r in found] == [f"<{B}t{i}>" for i in (2995, 2997, 2999)] and not any(r["more"] for r in found)
    assert all(r["more"] for r in browse.resources_with(library, f"<{EX}kind>", '"1"', limit=4).collect())
    assert browse.resources_with(library, f"<{EX}kind>", '"9"', limit=4).count() == 0
    again = Graph.open(spark, library.path, CFG)
    assert {"blocks", "listing", "groups", "group_starts"} <= set(again.__dict__)
    assert [r["page"] for r in browse.list_resources(again, limit=2, offset=5).collect()] == ["t0005", "t0006"]


def test_stars_go_by_sets_of_properties(spark):
    """Two small properties that the same few subjects repeat make more rows together than a large one that misses them."""
    p = {x: f"<{EX}{x}>" for x in "abc"}
    triples = [(f"<{B}s{i}>", p[x], f'"{x}{k}"') for i in range(10) for x, n in (("a", 10), ("b", 15)) for k in range(n)]
    triples += [(f"<{B}{i}>", p["c"], '"c"') for i in ("s0", *range(400))]
    g = Graph.load(frame(spark, triples), CFG)
    steps = [po(p[x], var(x)) for x in "cba"]
    stars = g.stars_of(p.values())
    assert stars.counts() == g.counts_of(p.values()) == {p["a"]: 100, p["b"]: 150, p["c"]: 401}
    assert stars.matches([p["a"]]) == 100 and stars.matches([p["a"], p["b"]]) == 1500 and stars.matches([p["a"], p["c"]]) == 10 and stars.matches([p["c"]]) == 401
    assert [s.prop for s in pattern._Matcher(g.facts, stars.counts()).ordered(steps)] == [p["a"], p["b"], p["c"]]
    assert [s.prop for s in pattern._Matcher(g.facts, stars.counts(), stars).ordered(steps)] == [p["a"], p["c"], p["b"]]
    found = match(g.facts, var("s"), steps, stars.counts(), stars)
    assert found.columns == ["s", "c", "b", "a"] and found.count() == 150
    some = match(g.facts, var("s"), [po(p["a"], var("x")), po(p["c"], '"c"'), optional(po(p["b"], var("y")))], stars.counts(), stars)
    assert some.count() == 150


def test_many_prefixes(spark):
    """Thousands of linked sets are one expression; the first of those that fit is taken, as with few."""
    r = random.Random(1)
    sets = [f"http://{r.choice('abcdef')}{i % 700}.org/{'x' * (i % 4)}{i % 13}" for i in range(10_000)] + ["http://a", "http://a1.org/", "http://zé/\U0010ffff", "http://b2.org/퟿"]
    sets = list(dict.fromkeys(sets))
    r.shuffle(sets)
    uris = [s + r.choice(["", "y", "\U0010ffff", "/z"]) for s in r.sample(sets, 400)] + ["http://", "http://q.org/1", "http://a7", "ftp://x", "", None, "http://zé/\U0010ffff\U0010ffff", "http://zé/", "http://zzz", "http://b2.org/"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    got = [x[0] for x in df.select(T.first_prefix("u", sets)).collect()]
    assert got == [None if u is None else next((i for i, s in enumerate(sets) if u.startswith(s)), None) for u in uris]
    targets = [x[0] for x in df.select(T.link_target("u", Config(base=B, linked_sets=tuple(sets)))).collect()]
    assert targets[:400] == [sets[i] for i in got[:400]]
    spaces = {f"q{i}": s for i, s in enumerate(sets)}
    few = dict(list(spaces.items())[: T.FEW])
    for prefixes in (spaces, few):
        cfg = Config(base=B, prefixes=prefixes)
        for u, x, y in df.select("u", T.compact("u", cfg), T.display_default("u", cfg)).where("u IS NOT NULL").collect():
            q = next((q for q, s in prefixes.items() if u.startswith(s)), None)
            assert (x["prefix"], x["rest"]) == (q, u[len(prefixes[q]) :] if q else u)
            assert y == (f"{q}:{u[len(prefixes[q]) :]}" if q else u)
        names = spark.createDataFrame([(f"q{i}:rest",) for i in (0, 5, 9000)] + [("q5",), ("nope:x",)], "c string")
        assert [x[0] for x in names.select(T.expand_column("c", prefixes)).collect()] == [prefixes[f"q{i}"] + "rest" if f"q{i}" in prefixes else None for i in (0, 5, 9000)] + [None, None]


def test_balanced_jdbc(spark, tmp_path):
    """Skewed keys, texts, and a value that half of the rows share: parts of about equal size, each row once."""
    url = f"jdbc:derby:{tmp_path}/skewed;create=true"
    r = random.Random(3)
    rows = [(int(r.expovariate(1) ** 6 * 10**9), f"it's {r.choice('abcz')}{r.randrange(10**6)}", i) for i in range(2000)] + [(None, "none", -1), (7, "none", -2)]
    tables.write_jdbc(spark.createDataFrame(rows, "k long, name string, id int"), url, "skewed", createTableColumnTypes="name VARCHAR(64)")
    schema = "k long, name string, id int"
    for keys in (["k"], ["name"], ["k", "id"]):
        found = tables.read_jdbc_balanced(spark, url, "skewed", schema, keys, 4)
        sizes = [x["n"] for x in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sorted(x["id"] for x in found.collect()) == sorted(x[2] for x in rows)
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    half = [(5 if i % 2 else i, i) for i in range(1000)]
    tables.write_jdbc(spark.createDataFrame(half, "k long, id int"), url, "half")
    found = tables.read_jdbc_balanced(spark, url, "half", "k long, id int", ["k", "id"], 5)
    sizes = [x["n"] for x in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sorted(x["id"] for x in found.collect()) == list(range(1000)) and len(sizes) == 5 and max(sizes) < 2 * min(sizes)
    assert tables.key_bounds(found.limit(0).select("k"), 4) == []


def test_queries_read_only_the_tables_of_their_properties(spark, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    for name in ("j1_star", "b2_subject", "g3_distinct", "h9_class"):  # without orders, lineitem and documents
        found = queries.QUERIES[name](spark, str(tmp_path))
        assert found.count() == queries.QUERIES[name](spark, SF).count() > 0


def test_repeated_keys_give_each_triple_once(spark, tmp_path):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "pages", "documents"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    # some lines twice, some with a second part or flag under the same key
    twice = "UNION ALL SELECT * REPLACE (l_partkey % 7 + 1 AS l_partkey) FROM t WHERE l_orderkey % 3 = 0 UNION ALL SELECT * REPLACE ('R' AS l_returnflag) FROM t WHERE l_orderkey % 2 = 0"
    con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/lineitem.parquet') SELECT * FROM t {twice}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "pages", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.execute(testmap.FACTS_SQL).fetchall())
    assert sorted(map(tuple, testmap.triples(spark, str(tmp_path)).collect())) == want
    some = {f"<{testmap.ONTOLOGY}{x}>" for x in ("part", "next", "returned")}
    assert sorted(map(tuple, testmap.triples(spark, str(tmp_path), *some).collect())) == [t for t in want if t[1] in some]


def test_rows_of_a_graph_without_repeats_are_not_compared(spark):
    facts = [(f"<{B}a>", f"<{B}ontology#x>", f"<{B}a#f>"), (f"<{B}a>", f"<{B}ontology#x>", f"<{B}b>"), (f"<{B}a#f>", f"<{B}ontology#y>", f"<{B}a>"), (f"<{B}b>", f"<{B}ontology#y>", "_:n"), ("_:n", f"<{B}ontology#y>", '"v"')]
    triples = spark.createDataFrame([(0, *t) for t in facts], "seq int, s string, p string, o string")
    made = graph_.MadeGraph(lambda *props: graph_.of_properties(triples, *props) if props else triples, CFG)
    want = Counter(tuple(r) for r in browse.lookup(Graph.load(triples, CFG)).drop("seq").collect())
    found = browse.lookup(made)
    assert Counter(tuple(r) for r in found.drop("seq").collect()) == want and max(want.values()) == 1
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_only_rows_that_can_match_are_shuffled(spark):
    rows = spark.createDataFrame([("<a>", 1), ("_:b", 2), ('"c"', 3), (None, 4)], "o string, n int")
    labels = spark.createDataFrame([("<a>", "x")], "o string, label string")
    out = graph_.join_some(rows, graph_.may_have_label("o"), labels, "o")
    assert sorted((r["n"], r["label"]) for r in out.collect()) == [(1, "x"), (2, None), (3, None), (4, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """Tables with repeated keys, a second part or flag under a key, and nulls."""
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for name in ("region", "nation", "supplier", "orders", "pages"):
        (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    changed = {
        "lineitem": "SELECT * FROM t UNION ALL SELECT * REPLACE (l_partkey % 7 + 1 AS l_partkey) FROM t WHERE l_orderkey % 3 = 0 UNION ALL SELECT * REPLACE ('R' AS l_returnflag) FROM t WHERE l_orderkey % 2 = 0",
        "part": "SELECT * REPLACE (CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS p_type) FROM t",
        "customer": "SELECT * REPLACE (nullif(c_custkey, 3) AS c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment) FROM t UNION ALL SELECT * FROM t WHERE c_custkey < 9",
        "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 > 0 THEN text END AS text) FROM t",
    }
    for name, sql in changed.items():
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{name}.parquet') {sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_triples_of_some_properties_are_those_of_all(spark, odd_tables):
    want = [tuple(r) for r in testmap.triples(spark, odd_tables).collect()]
    assert len(want) == len(set(want))
    own = [f"<{testmap.ONTOLOGY}{x}>" for x in ("item", "returned", "example", "next", "part", "flag", "nation", "segment")] + [f"<{testmap.LABEL}>"]
    for some in (*({p} for p in own), {own[0], own[5]}, {own[1], own[2]}, {own[4], own[5]}, set(own)):
        assert sorted(map(tuple, testmap.triples(spark, odd_tables, *some).collect())) == sorted(t for t in want if t[1] in some)
    assert sorted(r["s"] for r in testmap.uri_subjects(spark, odd_tables).collect()) == sorted({t[0] for t in want if t[0].startswith("<")})
    g = testmap.graph(spark, odd_tables)
    counted = queries.stats.triple_counts(g)
    assert tuple(counted.first()) == (g.facts.count(), g.page_rows.count())
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 9  # each table is read once


def test_steps_read_only_the_tables_of_their_property(spark):
    props = [f"<{testmap.ONTOLOGY}{x}>" for x in ("item", "part", "flag")] + [f"<{testmap.LABEL}>"]
    rows = testmap.graph(spark, SF).facts_of(*props)
    plan = graph_.of_properties(rows, f"<{testmap.LABEL}>")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_name" in plan and "l_orderkey" not in plan


def test_links_and_blank_nodes_are_made_of_their_tables_alone(spark, tmp_path):
    for folder, names in (("links", ("nation", "pages")), ("blanks", ("lineitem",))):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    for query, folder in (("g5_linksets", "links"), ("g9_shared_blanks", "blanks")):
        found = queries.QUERIES[query]
        assert sorted(map(tuple, found(spark, str(tmp_path / folder)).collect())) == sorted(map(tuple, found(spark, SF).collect()))


def test_names_of_subjects_make_no_objects(spark):
    for query in ("f15_display", "h10_titles"):
        assert "text" not in queries.QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_worked_out_once(spark):
    """A URI's display is part of every cell of a large result, so its steps must not stand in the plan again and again."""
    rows = [("<http://localhost:8080/aB_c>", "A B c"), ("<http://localhost:8080/orders/1>", "Orders/1"), ("<http://localhost:8080/camelCase%41+b>", "Camel CaseA b"), ("<http://localhost:8080/x%zz_y>", "X%zz y")]
    rows += [("<http://localhost:8080/>", "http://localhost:8080/"), ("<http://other/aB>", "http://other/aB"), ('"a_b"@en', "a_b"), ("_:b", ""), (None, None)]
    shown = spark.createDataFrame(rows, "t string, want string").select("t", "want", T.display_node("t", testmap.CONFIG).alias("got"))
    assert [r["t"] for r in shown.collect() if r["got"] != r["want"] and r["t"] is not None] == []
    assert shown.select("got")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == len(RDFS_NAMESPACES) + 1


def test_closures_read_only_the_tables_of_blank_nodes(spark, tmp_path):
    (tmp_path / "lineitem.parquet").symlink_to(f"{SF}/lineitem.parquet")
    found = queries.QUERIES["j10_closure"]
    assert sorted(map(tuple, found(spark, str(tmp_path)).collect())) == sorted(map(tuple, found(spark, SF).collect()))


def test_page_rows_are_made_without_functions_over_arrays(spark):
    rows = graph_.page_rows(frame(spark, [(ME, f"<{EX}p>", "_:b"), ("_:b", f"<{EX}p>", ME)]), CFG)
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.where("direction IS NULL").isEmpty()


def test_only_terms_that_can_have_labels_are_joined_with_them(spark):
    g = testmap.graph(spark, SF)
    can = {p: of for rows, of in g._by_labelled() for p in {r["p"] for r in rows.select("p").distinct().collect()}}
    assert can[f"<{testmap.DC}description>"] == can[f"<{testmap.ONTOLOGY}item>"] == set()  # texts and items are not shuffled
    assert can[f"<{testmap.ONTOLOGY}part>"] == {"o"} and can[f"<{testmap.ONTOLOGY}region>"] == {"s", "o"}


def test_trees_leave_one_table(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(documents, "stored", lambda df: kept.append(storage.stored(df)) or kept[-1])
    links = [(ME, f"<{EX}p>", "_:c0")] + [(f"_:c{i}", f"<{EX}next>", f"_:c{i + 1}") for i in range(9)]
    found = documents.property_tree(Graph.load(frame(spark, links), CFG))
    assert sorted(len(r["path"]) for r in found.collect()) == list(range(1, 11))
    assert len(kept) > 3 and sum(storage.exists(spark, t.__dict__["stored_at"]) for t in kept) == 1


def test_page_documents_do_not_make_rows_of_blank_nodes(spark, monkeypatch):
    def all_rows(graph):
        raise AssertionError("rows of all properties")

    want = queries.QUERIES["h8_documents"](spark, SF).count()
    monkeypatch.setattr(graph_.MadeGraph, "page_rows", property(all_rows))
    assert documents.page_documents(testmap.graph(spark, SF)).select("s").distinct().count() == testmap.uri_subjects(spark, SF).count() and want


def test_documents_are_made_of_sorted_rows(spark):
    """A page's rows are not gathered in one row first, and come together however batches cut them."""
    g = Graph.load(frame(spark, [(f"<{B}p{i % 7}>", f"<{EX}{'pq'[i % 2]}>", f'"{i}"@en' if i % 3 else f"_:b{i}") for i in range(100)]), CFG)
    want = {r["page"]: r["document"] for r in documents.export_jsonld(g).collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        found = documents.export_jsonld(g)
        assert {r["page"]: r["document"] for r in found.collect()} == want and len(want) == 7
    finally:
        spark.conf.set(key, before)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
