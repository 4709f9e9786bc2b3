"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random

import duckdb
import pytest

import compare
import plain
from conftest import TESTDATA
from quaestor.llm import oracles, prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def drawn(seed, n, ids=None):
    """Conversations that share beginnings, among them copies and prefixes of each other."""
    draw = random.Random(seed)
    out = {}
    for c in ids or draw.sample(range(10 * n), n):
        out[c] = [("user" if i % 2 else "bot", draw.choice("abc") * draw.randrange(1, 3)) for i in range(draw.randrange(1, 6))]
    return out


def rows_of(conversations):
    return [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run(spark, rows):
    found = prefix_trie.prefix_trie(prefix_trie.sequences(frame(spark, rows)))
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("shard_rows, degree", [(1024, 256), (4, 2)])
def test_nodes_as_a_dictionary_has_them(spark, monkeypatch, shard_rows, degree):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 4 * shard_rows)
    monkeypatch.setattr(prefix_trie, "DEGREE", degree)
    conversations = drawn(1, 90)
    assert run(spark, rows_of(conversations)) == plain.prefix_trie(conversations)


def test_walk_intersects_to_every_prefix():
    conversations = drawn(2, 60)
    keys = [[f"{role}:{text}".encode() for role, text in turns] for turns in conversations.values()]
    nodes = list(prefix_trie.walk(keys))
    prefixes = {tuple(k[:d]) for k in keys for d in range(len(k) + 1)}
    assert len(nodes) == len(prefixes) == len({n[0] for n in nodes})
    for _, _, depth, bits, ended in nodes:
        who = list(prefix_trie.members(bits))
        prefix = keys[who[0]][:depth]
        assert who == [i for i, k in enumerate(keys) if k[:depth] == prefix]
        assert list(prefix_trie.members(ended)) == [i for i, k in enumerate(keys) if k == prefix]
    assert list(prefix_trie.walk([])) == [(prefix_trie.ROOT, None, 0, 0, 0)]


def test_a_very_long_conversation_and_one_that_all_share(spark):
    conversations = {5: [("user", f"t{i}") for i in range(3000)], **{c: [("user", "t0")] for c in range(100, 700)}}
    found = run(spark, rows_of(conversations))
    assert len(found) == 3001
    by = {(r[0], r[1]): r for r in found}
    ends = hashlib.sha256(",".join(map(str, range(100, 700))).encode()).hexdigest()
    assert by[5, 1] == (5, 1, 5, 601, 1, 1, 1200, ends)
    assert by[5, 3000][2:7] == (5, 1, 0, 1, 0)
    assert by[5, 0] == (5, 0, None, 601, 1, 1, 1200, hashlib.sha256(b"").hexdigest())


def test_nulls_ties_repeats_clashing_columns_and_an_empty_table(spark):
    rows = [
        (1, 0, "user", "hi"), (1, None, None, "first"), (2, 1, "user", "hi"), (2, 0, "", "first"), (3, 0, "user", None),
        (3, 0, "user", ""), (None, 0, "user", "lost"), (4, 0, "user:", "x"), (6, 0, "user", ":x"),
    ]
    conversations = {
        1: [("", "first"), ("user", "hi")], 2: [("", "first"), ("user", "hi")], 3: [("user", ""), ("user", "")],
        4: [("user:", "x")], 6: [("user", ":x")],
    }
    df = frame(spark, rows).selectExpr("*", "1 AS n", "'z' AS node")
    found = prefix_trie.prefix_trie(prefix_trie.sequences(df).selectExpr("*", "2 AS ends", "true AS leaf"))
    assert sorted(map(tuple, found.collect())) == plain.prefix_trie(conversations)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(df.limit(0))).count() == 0
    turnless = spark.createDataFrame([(7, []), (8, [])], f"conv_id long, turns {prefix_trie.TURNS}")
    assert sorted(map(tuple, prefix_trie.prefix_trie(turnless).collect())) == plain.prefix_trie({7: [], 8: []})


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_as_plain_python_and_as_its_sql(spark, scale):
    folder = f"{TESTDATA}/{scale}"
    found = queries.op12_prefix_trie(spark, folder)
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    assert sorted(map(tuple, found.collect())) == plain.prefix_trie(plain.rebuilt(rows))
    con = compare.connect(folder)
    assert compare.differences(found, con, oracles.PREFIX_TRIE) is None
    con.close()
