"""JSONPath against a small evaluator and golden values."""

import json

import pytest
from pyspark.sql import functions as F

from folia.functions import jsonpath

DOC = {
    "users": [{"name": "Ann", "age": 31, "tags": ["x", "y"], "on": True}, {"name": "Bob", "age": 7.5, "on": False, "odd.key": {"it's": 1}}, {"name": None, "tags": []}, "none"],
    "0": "zero", "n": None, "deep": {"name": "inner", "list": [[1, 2], [3]]}, "é": "ü",
}
GOLDEN = [
    ("$", [DOC]), ("$.users[0].name", ["Ann"]), ("users[1].age", [7.5]), ("$.users[9].name", []), ("$.users[-1]", []), ("$.users.name", []), ("$.n", [None]), ("$.missing", []), ("$.users[2].name", [None]),
    ("$.users[*].name", ["Ann", "Bob", None]), ("$.users[*].tags[*]", ["x", "y"]), ("$.users[1]['odd.key'][\"it's\"]", [1]), ("$['é']", ["ü"]), ("$.é", ["ü"]), ("$.deep.*", [[[1, 2], [3]], "inner"]),
    ("$.users[1:3].name", ["Bob", None]), ("$.users[:1].name", ["Ann"]), ("$.users[-2:].name", [None]), ("$.deep.list[*][0]", [1, 3]),
    ("$.users[?(@.age > 7)].name", ["Ann", "Bob"]), ("$.users[?(@.age >= 7.5 && @.on == true)].name", ["Ann"]), ("$.users[?(@.name == 'Bob' || @.tags)].name", ["Ann", "Bob", None]), ("$.users[?(@.name == null)].tags", [[]]),
    ("$.users[?(!@.age)].name", [None]), ("$.users[?(@.name != 'Ann')].name", ["Bob", None]), ("$.users[?(@ == 'none')]", ["none"]), ("$.users[?(@.age == '31')]", []), ("$.users[?(@.name == 'a && b')]", []), ("$.users[?(@.tags[0] == \"x\")].age", [31]),
    ("$..name", ["Ann", "Bob", None, "inner"]), ("$..[0]", [DOC["users"][0], "x", [1, 2], 1, 3]), ("$..list[*][*]", [1, 2, 3]), ("$..*", None), ("$..users[?(@.on == false)].age", [7.5]),
]


def values(spark, expr, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, j string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def below(x):
    kids = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return len(kids) + sum(map(below, kids))


def test_paths(spark):
    j, source = F.col("j"), json.dumps(DOC)
    df = spark.createDataFrame([(source,)], "j string").select(*(F.transform(jsonpath.find_all(j, p), lambda v: F.to_json(v)).alias(f"p{k}") for k, (p, _) in enumerate(GOLDEN)), *(F.to_json(jsonpath.find(j, p)).alias(f"f{k}") for k, (p, _) in enumerate(GOLDEN)))
    row = df.first()
    for k, (path, want) in enumerate(GOLDEN):
        got = [json.loads(x) for x in row[f"p{k}"]]
        if want is None:
            assert len(got) == below(DOC) == 29, path
            continue
        assert got == want, path
        assert (json.loads(row[f"f{k}"]) if row[f"f{k}"] is not None else "nothing") == (want[0] if want else "nothing"), path


def test_dotted_paths_and_texts(spark):
    j = F.col("j")
    cols = [jsonpath.text(jsonpath.dotted(j, p)).alias(f"c{k}") for k, p in enumerate(["users[0].name", "users.1.age", "0", "users.0.tags", "users.7.name", "n", "deep.list[1][0]", "x.y"])]
    assert list(spark.createDataFrame([(json.dumps(DOC),)], "j string").select(*cols).first()) == ["Ann", "7.5", "zero", '["x","y"]', None, "null", "3", None]


def test_odd_sources(spark):
    docs = [None, "", "no json", "[1,[2]]", '"text"', "3", "{}"]
    assert values(spark, F.to_json(jsonpath.find(F.col("j"), "$[1][0]")), docs) == [None, None, None, "2", None, None, None]
    assert values(spark, F.size(jsonpath.find_all(F.col("j"), "$..*")), docs) == [0, 0, 0, 3, 0, 0, 0]
    assert values(spark, F.size(jsonpath.find_all(F.col("j"), "$[*]")), docs) == [0, 0, 0, 2, 0, 0, 0]
    assert spark.createDataFrame([], "j string").select(jsonpath.find(F.col("j"), "$.a")).count() == 0


@pytest.mark.parametrize("path", ["$.a[", "$.a[?(b > 1)]", "$[a]", "$.a..b"])
def test_unreadable_paths(path):
    with pytest.raises(ValueError):
        jsonpath.find_all(F.lit("{}"), path)


def test_a_field_of_a_record_by_its_pointer(spark):
    from folia.sources import resolve

    df = spark.createDataFrame([("mongodb://h/db/c/7/users[1].age",), ("mongodb://h/db/c/7/users.0.name",), ("mongodb://h/db/c/7",), ("mongodb://h/db/c/7/none.x",)], "uri string").withColumn("record", F.lit('{"users":[{"name":"Ann"},{"age":3}]}'))
    got = [r[0] for r in df.select(resolve.mongo_field(F.col("uri"), F.col("record"))).collect()]
    assert got == ["3", "Ann", '{"users":[{"name":"Ann"},{"age":3}]}', None]
