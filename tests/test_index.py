"""The trigram index against plain searches; outputs; depths of graphs; statistics of logs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lineloom.operators import documents, graph, index, logs
from lineloom.sources import lines as L
from lineloom.sources import sinks

TEXTS = [(1, "The License is here"), (2, "a licence\nno license"), (3, ""), (4, None), (5, "ab"), (6, "LICENSES é漢字 fooo bar"), (7, "fo bar"), (None, "license without id"), (2, "a second text of an id, foo bar")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc long, text string, tri string, n int")


def found(df):
    return sorted((r.doc, r.text) for r in df.collect())


def test_searches(docs):
    made = index.build(docs, "doc", "text")
    known = [(i, t) for i, t in TEXTS if i is not None and t is not None]
    assert index.stats(made).first().texts == 4
    for pattern in ("license", "LICENSE", "é漢字", "ab", "", "nowhere"):
        assert found(index.search(made, docs, "doc", "text", pattern)) == sorted((i, t) for i, t in known if pattern.lower() in t.lower())
    for pattern in (r"fo*o? bar", r"licen[cs]e", r"licens?e\b", r"(?:foo|fo) bar", r"fo{1,3} bar", r"a|b", r"is \w+re", r"no licen.e"):
        assert found(index.search_regex(made, docs, "doc", "text", pattern)) == sorted((i, t) for i, t in known if re.search(pattern, t)), pattern
    for pattern, regex in (("a lic*", "^a lic.*$"), ("*bar", "^.*bar$"), ("fo?o bar", "^fo.o bar$")):
        assert found(index.search_glob(made, docs, "doc", "text", pattern)) == sorted((i, t) for i, t in known if re.search(regex, t, re.M))
    assert index.build(docs.limit(0), "doc", "text").count() == 0


def test_literals_are_in_every_match():
    assert index.literals("abcd*efg") == ["abc", "efg"] and index.literals(r"x\.yz[a]q{2}lmn") == ["x.yz", "lmn"]
    assert index.literals("ab(cde)?") == [] and index.literals("abc|def") == [] and index.literals(r"\d\dabc+") == []


def test_stale_and_updated(spark, tmp_path):
    old = spark.createDataFrame([(1, "one text"), (2, "two texts"), (3, "three"), (4, None)], "doc long, text string")
    new = spark.createDataFrame([(1, "one text"), (2, "two others"), (4, "four"), (5, "five")], "doc long, text string")
    index.save(index.build(old, "doc", "text"), f"{tmp_path}/index")
    held = index.load(spark, f"{tmp_path}/index")
    changes = index.stale(index.entries(old, "doc", "text"), new, "doc", "text")
    assert {tuple(r) for r in changes.collect()} == {(2, "changed"), (3, "removed"), (4, "changed"), (5, "added")}
    rows = lambda df: sorted(map(tuple, df.select("tri", "id").collect()))
    assert rows(index.updated(held, changes, new, "doc", "text")) == rows(index.build(new, "doc", "text"))


def test_outputs(spark, tmp_path):
    rows = [(1, 'a "b", c', None), (2, "x\ny", 2.5), (None, "", 0.0)]
    df = spark.createDataFrame(rows, "i int, t string, v double")
    values = lambda d: [r.value for r in d.collect()]
    assert [json.loads(v) for v in values(sinks.json_lines(df))] == [{"i": i, "t": t, "v": v} for i, t, v in rows]
    assert [json.loads(v) for v in values(sinks.pretty_json(df))] == [{"i": i, "t": t, "v": v} for i, t, v in rows]
    assert values(sinks.csv_lines(df)) == ['1,"a ""b"", c",', '2,"x\ny",2.5', ",,0.0"]
    assert values(sinks.yaml_lines(df))[:2] == ['- i: 1\n  t: "a \\"b\\", c"\n  v: null', '- i: 2\n  t: "x\\ny"\n  v: 2.5']
    assert values(sinks.human_lines(df))[1] == "i: 2  t: x\ny  v: 2.5"
    for kind in ("jsonl", "csv", "yaml", "human", "parquet"):
        sinks.save(df, f"{tmp_path}/{kind}", kind)
    assert sorted(spark.read.options(header=True, multiLine=True, escape='"').csv(f"{tmp_path}/csv").select("t").toPandas().t.fillna("")) == ["", 'a "b", c', "x\ny"]
    assert spark.read.json(f"{tmp_path}/jsonl").count() == spark.read.parquet(f"{tmp_path}/parquet").count() == 3
    sinks.save_lines(L.from_local(spark, ["b", "a"]), f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["a", "b"]


def test_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "b"), ("x", "y"), ("y", "x"), ("y", "z"), (None, "a")], "a string, b string")
    assert {tuple(r) for r in graph.depths(edges).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None), ("z", None)}
    assert [r.node for r in graph.topological(edges).collect()] == ["a", "b", "c"]
    assert graph.depths(edges.limit(0)).count() == 0


def test_log_statistics(spark):
    lines = ['{"level":"warn","msg":"m"}', '{"level":"warn","msg":"m"}', "level=error msg=n", "nothing", "  "]
    got = logs.statistics(logs.parse_all(spark.createDataFrame([(x,) for x in lines], "content string")), top=1)
    assert {tuple(r) for r in got.collect()} == {("records", "", 3), ("errors", "", 1), ("severity", "warn", 2), ("severity", "error", 1), ("format", "json", 2), ("format", "key=value", 1), ("message", "m", 2)}


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Cats sleep. Cats eat fish. Dogs bark."), (2, None), (3, "")], "id long, text string")
    got = [(r.id, r.word) for r in documents.keywords(df, "id", "text", 2).orderBy(F.col("score").desc(), "word").collect()]
    assert got == [(1, "cats"), (1, "bark")]
