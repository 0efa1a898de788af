"""The trie of conversation prefixes against brute force."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from linkedframe.llm import queries, trie
from linkedframe.llm.common import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, u long, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(found)] for c, found in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        whole[c] = tuple(base[:h] + found[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in children[node]) or 1
        saved = sum(sums[x][1] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        sums[node] = leaves, saved
    out = []
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if whole[c] == node)))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def chains(n, stem, ends):
    """Conversations that share a long stem and part at several places."""
    return [(c, t, "user" if t % 2 else "assistant", "é" * (t % 7) if t < stem + 3 * (c % 4) else f"{c % 6} {t}") for c in range(n) for t in range(ends - c % 11)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(3, 0, "user", "a")],  # its base is absent: no turn is left where h is above 0
        [(None, 0, "user", "no id"), (0, None, None, None), (0, 1, "user", None), (1, 1, None, "x"), (2, None, "", ""), (2, None, "", "")],
        [(-7, t, "r", "x") for t in range(12)] + [(-5, t, "r", "y") for t in range(3)] + [(-4, 5, "r", "z"), (4, 1, "r", "z"), (0, 1, "r", "z")],
        [(c, 1, "user", "same") for c in range(40)] + [(c, 2, "user", "same") for c in range(20)] + [(c, 2, "user", "same") for c in range(5)],
        [(c, 7, "user", x) for c in range(10) for x in ("tie", "tie", "", "b" * 200 + str(c % 3))],
        chains(25, 9, 20),
        chains(12, 60, 90),
    ],
)
def test_trie(spark, rows):
    assert made(trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_long_conversations_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(trie, "REACH", 2)
    monkeypatch.setattr(trie, "TOGETHER", 2)
    rows = chains(9, 70, 120)
    assert made(trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_many_conversations_end_at_a_node(spark):
    rows = [(c, 0, "user", "x") for c in range(0, 5000, 5)]
    assert made(trie.prefix_trie(table(spark, rows).repartition(7))) == brute(rows)


def test_trie_query(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations", "conv_id", "turn", "role", "text").collect()]
    found = queries.op12_prefix_trie(spark, SF)
    assert found.columns == COLUMNS
    assert made(found) == brute(rows)
