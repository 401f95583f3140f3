"""Prefix tries against a plain dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import trie

TURNS = "conv_id bigint, turn bigint, role string, text string, path string, key int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def own_turns(rows):
    """conv_id: its (role, text) in order; turns that share a number in the order of digests."""
    out = {}
    for r in rows:
        if r[0] is not None:
            out.setdefault(r[0], []).append(r)
    unit = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256((r[2] or "").encode()).hexdigest(), unit(r[2] or "", r[3] or ""))
    return {c: [(r[2] or "", r[3] or "") for r in sorted(turns, key=key)] for c, turns in out.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    own = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    rows = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), leaves, sum(own[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def turns(rng, n):
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        for t in range(rng.randint(1, 9)):
            role, text = rng.choice(["user", "assistant", None, "système"]), rng.choice(["a", "bé", "", None, "日本 語", "long " * 50])
            rows.append((c, rng.choice([t, t, t, None]), role, text, "p", 1))
    return [*rows, (None, 0, "user", "no id", "p", 1)]


@pytest.mark.parametrize(("limit", "seed"), [(100_000, 1), (30, 2), (1, 3), (0, 4)])
def test_nodes_equal_all_prefixes(spark, limit, seed):
    rows = turns(random.Random(seed), 60)
    given = spark.createDataFrame(rows, TURNS).repartition(5)
    paths = trie.conversation_paths(given)
    assert found(trie.prefix_trie(paths, limit)) == brute({c: tuple(t) for c, t in own_turns(rows).items()})
    assert found(trie.prefix_trie(trie.branched(paths), limit)) == brute(rebuilt(own_turns(rows)))


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"turn {t}", "p", 1) for c in range(1, 3001) for t in range(3)]
    nodes = trie.prefix_trie(trie.conversation_paths(spark.createDataFrame(rows, TURNS).repartition(7)))
    ends = hashlib.sha256(",".join(map(str, range(1, 3001))).encode()).hexdigest()
    assert [r[7] for r in found(nodes) if r[1] == 3] == [ends]
    assert {r[3] for r in found(nodes)} == {3000}


def test_a_hot_opening_is_dealt_by_its_next_turns(spark):
    """All conversations open with the same two turns; a task gets little more than the limit."""
    rows = [(c, t, "user", "same" if t < 2 else f"{c % 400} {t}", "p", 1) for c in range(800) for t in range(5)]
    paths = trie.conversation_paths(spark.createDataFrame(rows, TURNS))
    nodes = trie.prefix_trie(paths, limit=50)
    assert found(nodes) == found(trie.prefix_trie(paths))
    assert nodes.filter("depth <= 2").count() == 3 and nodes.filter("depth = 2").first()["n_children"] == 400


def test_long_conversation_and_nothing(spark):
    rows = [(1, t, "user", "x" * (t % 7), "p", 1) for t in range(4000)] + [(6, t, "user", "x" * (t % 7), "p", 1) for t in range(3990)]
    nodes = trie.prefix_trie(trie.conversation_paths(spark.createDataFrame(rows, TURNS)))
    assert nodes.count() == 4001 and nodes.agg(F.max("depth")).first()[0] == 4000
    assert nodes.filter("depth = 3990").first()["n_convs"] == 2 and nodes.filter("depth = 3991").first()["n_convs"] == 1
    assert trie.prefix_trie(trie.conversation_paths(spark.createDataFrame([], TURNS))).count() == 0


def test_turns_of_nodes(spark):
    given = spark.createDataFrame([(1, 0, "user", "hi", "p", 1), (1, 1, None, None, "p", 1), (2, 0, "user", "hi", "p", 1)], TURNS)
    nodes = trie.with_turns(trie.prefix_trie(trie.conversation_paths(given)), given)
    assert sorted((r["depth"], r["role"], r["text"]) for r in nodes.collect()) == [(0, None, None), (1, "user", "hi"), (2, "", "")]
