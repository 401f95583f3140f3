"""Debug information and source spans against what was written."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import source_spans
from lodestone.plans import made_binaries
from lodestone.sources import debug


class Held:
    """Bytes that are read like a file."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def parts(first, n):
    return pd.DataFrame({"p_partkey": range(first, first + n), "p_name": [f"big gear {k % 7}" for k in range(n)], "p_size": [1 + k * 7 % 50 for k in range(n)]})


def tables(data):
    try:
        binary = debug.Binary(Held(data), len(data))
    except debug.Broken:
        return None
    return {t: [r for u in debug.unit_heads(binary, 0, 1 << 60) for r in debug.unit_rows(binary, t, *u)] for t in debug.SCHEMAS}


@pytest.mark.parametrize("first", [0, 500])
def test_versions_and_byte_orders(first):
    got = tables(made_binaries.make(parts(first, 100)))
    assert [u[1] for u in got["units"]] == [2 + (first // 25 + k) % 4 if (first // 25 + k) % 5 != 4 else None for k in range(4)]
    assert all(f[10] or f[4] for f in got["functions"])  # ranges, or declared only


def test_damaged_binaries_raise_nothing():
    """Bytes changed, cut off and put in: fewer rows or nulls, and no error or endless loop."""
    good, rng = made_binaries.make(parts(0, 60)), random.Random(5)
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(bad))
            bad[at : at + rng.randint(0, 3)] = rng.randbytes(rng.randint(0, 3))
        tables(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])]))
    assert tables(b"") is None and tables(b"\x7fELF") is None


def test_slices_read_each_unit_once(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for n, folder in ((0, tmp_path), (1, tmp_path / "more")):
        (folder / f"b{n}").write_bytes(made_binaries.make(parts(500 * n, 500)))
    (tmp_path / "text").write_text("no binary")
    (tmp_path / "empty").write_bytes(b"")
    spark.dataSource.register(debug.DebugInfo)
    read = lambda step: spark.read.format("debug_info").option("table", "functions").option("sliceBytes", step).load(str(tmp_path))
    few, many = read(1 << 30), read(300)
    assert many.rdd.getNumPartitions() > 100 > few.rdd.getNumPartitions()
    rows = sorted(map(repr, few.collect()))
    assert rows == sorted(map(repr, many.collect())) and len(rows) == 1000 - 25 * 8


def statement(rng, deep):
    """(text, [(type, begin, end, depth)]) of a random statement; depths from 0."""
    if deep > 9 or rng.random() < 0.3:
        return rng.choice([("x = f(1, (2));", []), (";", []), ("return '}' + 1;", [("return_statement", 0, 15, 0)]), ("goto out;", [("goto_statement", 0, 9, 0)]), ('s = "{ if (" /* } */;', []), ("int a[2] = { 1, 2 };", []), ("// if (a) {\n b++;", [])])
    kind = rng.choice(["if", "else", "for", "while", "do", "switch", "block", "label"])
    inner = lambda down=1: [(t, nodes, down) for t, nodes in [statement(rng, deep + 1)]][0]
    if kind == "block":
        pieces = ["{ ", *[x for _ in range(rng.randint(0, 3)) for x in (inner(), " ")], "}"]
        return joined("compound_statement", pieces)
    if kind == "if":
        return joined("if_statement", ["if (a ? b : (c)) ", ("{ }", [("compound_statement", 0, 3, 0)], 1)])
    if kind == "else":
        return joined("if_statement", ["if (a) ", ("{ x; }", [("compound_statement", 0, 6, 0)], 1), " else ", inner(2)])
    if kind == "switch":
        body = joined("compound_statement", ["{ case 1: ", inner(2), " default: ", inner(2), " }"])
        return joined("switch_statement", ["switch (a) ", (*body, 1)])
    if kind == "do":
        return joined("do_statement", ["do ", ("{ y; }", [("compound_statement", 0, 6, 0)], 1), " while (a);"])
    return joined({"for": "for_statement", "while": "while_statement", "label": "labeled_statement"}[kind], [{"for": "for (;;) ", "while": "while (a) ", "label": "out: "}[kind], inner()])


def joined(kind, pieces):
    text, nodes = "", []
    for p in pieces:
        t, below, down = (p, [], 0) if isinstance(p, str) else p
        nodes += [(k, len(text) + a, len(text) + z, d + down) for k, a, z, d in below]
        text += t
    return text, [(kind, 0, len(text), 0), *nodes]


@pytest.mark.parametrize("seed", range(40))
def test_spans_equal_those_of_written_trees(seed):
    rng = random.Random(seed)
    text, want = "#define F(x) {\n/* int f() { */ struct s { int (*g)(int); } q = { 0 };\nextern int p(int);\n", []
    for n in range(6):
        sign = rng.choice([f"static int f{n}(int a, char *b) ", f"struct s *f{n}(void)\n", f"int (*f{n}(int a))(int) ", f"__attribute__((x)) void (f{n})(void) "])
        body, nodes = joined("compound_statement", ["{ ", *[(*statement(rng, 0), 1) for _ in range(rng.randint(0, 4))], " }"])
        at = len(text) + len(sign)
        want.append((f"f{n}", len(text), at, at + len(body), sorted((k, at + a, at + z, d + 1) for k, a, z, d in nodes)))
        text += sign + body + "\n" + rng.choice(["", "typedef int (*t)(int);\n", "int v = sizeof(int);\n"])
    got = [(f["name"], f["start_byte"], f["body_byte"], f["end_byte"], sorted((x["node_type"], x["start_byte"], x["end_byte"], x["depth"]) for x in f["nodes"])) for f in source_spans.functions_of(text)]
    assert got == want
    for f in source_spans.functions_of(text):
        assert f["start_line"] == text[: f["start_byte"]].count("\n") and f["end_line"] == text[: f["end_byte"]].count("\n")


def test_ten_megabytes_and_odd_texts_take_linear_time():
    began = time.time()
    assert len(source_spans.functions_of("int f(int a) { if (a) { return 'x'; } }\n" * 250_000)) == 250_000
    for odd in ("int f(){" + "{" * 500_000, "/* " * 500_000, '"' * 500_001, "if (" * 300_000, "int f(){" + "if (a) x; else " * 200_000, "f(" * 200_000 + ")" * 200_000, "\\\n" * 300_000, "日本" * 300_000):
        source_spans.functions_of(odd)
    assert time.time() - began < 120


def test_functions_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "int f(void) { return 1; }", None)], "id int, text string, name string")
    got = source_spans.with_functions(df).select("id", "name", F.size("functions").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, "x", 0), (2, "y", 0), (3, None, 1)]
