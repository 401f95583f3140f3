"""Answers read by the JVM and by Python give the same."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.operators import flatten


def answers():
    rng = random.Random(2)
    names = ["foo", "get_user", "`x1`", '"q"', "the name is: foo", "a b", "", 5, None, True, "é", "```f```", "name", "ends."]
    for _ in range(1500):
        entry = lambda: {"name": rng.choice(names), **rng.choice([{}, {"confidence": rng.choice([0.5, 1, 7, -1, "0.3", None, 1e-9, [1], True])}, {"x": "}"}])}
        value = rng.choice([entry(), [entry() for _ in range(rng.randint(0, 4))], {"predictions": [entry() for _ in range(rng.randint(0, 4))]}, {"predictions": entry()}, {"predictions": None, "name": "z"}, [5, entry()], "text", 3, {"y": 1}])
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        text = rng.choice(["{t}", "{t}", "  {t}\n", "{t} trailing", "{t}]", "{t}}}", '{t}, "w": 1', "{t}, 1", "```json\n{t}\n```", "Sure:\n```JSON {t}```", "```\n{t}\n```", "I think {t} fits", " {t}", "[{t}", "```json\n```\n```\n{t}\n```", '{{"name": "a", "name": "b"}}', "NaN", '{{"name": "n", "confidence": NaN}}']).replace("{t}", text).replace("{{", "{").replace("}}", "}")
        yield text
    yield from (None, "", "   ", "plain", "The function name is: foo", '{"name":"a"}')


def plain(r):
    return [(p["name"], p["confidence"]) for p in r["predictions"]], r["parse_ok"], r["parse_error"], r["raw_text"]


def test_both_ways_agree(spark):
    given = list(answers())
    df = spark.createDataFrame(list(enumerate(given)), "n int, text string").repartition(3)
    got = {r.n: plain(r.a) for r in df.select("n", parse.parse_answers(F.col("text")).alias("a")).collect()}
    for n, text in enumerate(given):
        assert got[n] == plain(parse.parse_answer(text)), text


def test_plain_answers_need_no_python(spark):
    """The JVM's part leaves nothing of them to the UDF."""
    rows = [('{"name": "a", "confidence": 0.5}',), ('[{"name": "b"}, {"name": "`c`"}]',), ('Sure:\n```json\n{"predictions": [{"name": "d"}]}\n```',)]
    df = spark.createDataFrame(rows, "text string")
    left = []
    was = parse.parse_any
    parse.parse_any = lambda text: left.append(text) or F.lit(None).cast(parse.ANSWER)
    try:
        out = df.select(parse.parse_answers(F.col("text")).alias("a")).select("a.parse_ok", F.col("a.predictions.name").alias("names")).collect()
    finally:
        parse.parse_any = was
    assert left and sorted((r.parse_ok, r.names) for r in out) == [(True, ["a"]), (True, ["b", "c"]), (True, ["d"])]


def test_columns_are_found(spark):
    df = spark.createDataFrame([(1, '{"A": 1, "b c": 2}'), (2, '{"Z": 5}'), (3, None), (4, "no json")], "id int, m string")
    got = flatten.found_columns(df, "m", "r_")
    assert got.columns == ["id", "r_A", "r_Z", "r_b c"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 2), (2, 0, 5, 0), (3, 0, 0, 0), (4, 0, 0, 0)]
    assert flatten.found_columns(df.filter("id > 2"), "m", "r_").columns == ["id"]
