import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lineloom.operators import documents
from lineloom.plans import advice, colon
from lineloom.plans.language import QueryError, parse
from lineloom.sources import lines as L


@pytest.mark.parametrize(
    ("text", "lines", "wanted"),
    [
        ("grep:b | count", ["ab", "c"], ["1"]),
        ("sed:a->x | head:1", ["aa", "b"], ["xx"]),
        ("replace:s/a/x/", ["aa"], ["xa"]),
        ("awk:2 | sort:1 -n -r | tail:1", ["a 2", "b 10"], ["a 2"]),
        ("uniq", ["a", "b", "a"], ["a", "b"]),
    ],
)
def test_colon_syntax(spark, text, lines, wanted):
    assert [r.content for r in colon.run(L.from_local(spark, lines), colon.parse(text)).sorted().collect()] == wanted


def test_colon_errors_and_mappings(spark):
    with pytest.raises(QueryError):
        colon.parse("nothing:x")
    found = colon.run(L.from_local(spark, ["A", "b"]), colon.from_mapping([{"type": "search", "pattern": "a"}]))
    assert [r.content for r in found.rows().collect()] == ["A"]


def test_advice():
    assert advice.advice(parse('sort | find "x" | count | take 1')) == ["find could come before sort: it leaves fewer lines to order", "take after count sees a single line"]


def test_markdown(spark):
    text = "# One *x*\n[a](http://b)\n| h | i |\n|---|---|\n| 1 | 2 |\n"
    rows = L.from_table(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").rows()
    assert [tuple(r)[2:] for r in documents.headings(rows).collect()] == [(1, "One *x*", "one-x")]
    assert documents.links(rows).first()["target"] == "http://b"
    assert [r.cells for r in documents.table_rows(rows).orderBy("row").collect()] == [["h", "i"], ["1", "2"]]


def test_differences_and_commits(spark):
    df = spark.createDataFrame([('{"a":1,"b":[1]}', '{"a":2,"b":[1,3],"c":null}', "feat(x)!: do")], "a string, b string, m string")
    assert [tuple(c) for c in df.select(documents.json_diff("a", "b")).first()[0]] == [("replace", "/a", "2"), ("add", "/b/1", "3"), ("add", "/c", "null")]
    assert tuple(df.select(documents.commit(F.col("m")).alias("c")).first()["c"]) == ("feat", "x", True, "do")
    assert documents.version_bump(df, "m").first()["bump"] == "major"


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("n.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    found = documents.tar_entries(spark.read.format("binaryFile").load(str(tmp_path / "*.gz"))).first()
    assert (found["name"], bytes(found["content"])) == ("n.txt", b"hi")


def test_pairs_and_summary(spark):
    df = spark.createDataFrame([(1, "aab aab ab. Other words here. Last one")], "i int, t string")
    assert documents.learn_pairs(df, "t", 2)[0] == ("a", "b")
    assert documents.summary(df, "i", "t", 1, "lead").first()["summary"] == "aab aab ab."
    assert documents.summary(df, "i", "t", 2).count() == 1
