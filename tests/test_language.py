import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineloom.plans.compiler import between_mask, observed, query
from lineloom.plans.language import QueryError, explain, parse
from lineloom.sources import lines as L


@pytest.fixture
def run(spark):
    return lambda text, lines, **k: [r.content for r in query(L.from_local(spark, lines), text, **k).sorted().collect()]


def test_aliases_and_case():
    assert parse('SEARCH "x" nocase | uniq | head 3') == parse('find "x" ignore_case | unique | take 3')


def test_conditions_group_to_the_right():
    c = parse('filter field 1 > 1 and field 2 > 2 or line has "x"')[0].args["condition"]
    assert c[0] == "and" and c[2][0] == "or"


@pytest.mark.parametrize("text", ["find", "take x", 'find "a" extra', "filter field 1 >= 2", "sum field 2", 'find "a" | ?', "call"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_lenient_ignores_what_follows():
    assert parse("sort numeric desc", lenient=True)[0].args["numeric"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_parser_never_breaks(text):
    try:
        explain(parse(text))
    except QueryError:
        pass


@pytest.mark.parametrize(
    ("text", "lines", "wanted"),
    [
        ('find "b" | count', ["ab", "cd", "b"], ["2"]),
        ('find "A" ignore_case invert', ["ab", "É"], ["É"]),
        ('find "a|b" whole_word', ["a|b", "xa|bx"], ["a|b"]),
        ("find /[0-9]+/ only_match max 1", ["x12y", "3"], ["12"]),
        ("sort desc | take 2", ["a", "c", "b"], ["c", "b"]),
        ("sort numeric", ["10", "9", "x"], ["x", "9", "10"]),
        ("unique", ["a", "b", "a", "c"], ["a", "b", "c"]),
        ("skip 1 | last 1", ["a", "b", "c"], ["c"]),
        ("select 3, 1", ["a b c", "d"], ["c\ta", "\td"]),
        ('set separator "," | filter field 2 > 28', ["n,age", "x,30", "y,20"], ["x,30"]),
        ('filter field 5 != "x"', ["a"], ["a"]),
        ('replace /(\\w)(\\d)/ with "${2}$1" all', ["a1 b2"], ["1a 2b"]),
        ('replace "o" with "$$0"', ["foo"], ["f$0o"]),
        ('replace "a" with "b" in lines 2 to 2', ["a", "a"], ["a", "b"]),
        ('delete matching "#"', ["#x", "y"], ["y"]),
        ('insert "--" before "b" | insert "++" after "b"', ["a", "b"], ["a", "--", "b", "++"]),
        ('find "x" between /S/ and /E/', ["x", "S x", "x1", "E x", "x2"], ["S x", "x1", "E x"]),
        ("aggregate sum 1", ["1.5", "x", "1e3", " 5 "], ["1001.5"]),
        ("aggregate avg 1", [], ["0"]),
        ("aggregate min 1", ["x"], ["inf"]),
        ("aggregate distinct 1", ["b", "a", "b"], ["a, b"]),
        ("aggregate freq 1", ["b", "a", "b"], ['{"a":1,"b":2}']),
        ("group by field 1 aggregate count, avg 2", ["b x", "a 2", "b 4"], ["b\t2\t2", "a\t1\t2"]),
        ('if line contains "z" then count else take 1 end', ["a", "b"], ["a"]),
        ('def f = find "a" | count end | call f', ["a", "b"], ["1"]),
        ("let n = 3 | count", ["a"], ["1"]),
    ],
)
def test_stages(run, text, lines, wanted):
    assert run(text, lines) == wanted


def test_undefined_call(run):
    with pytest.raises(QueryError):
        run("call g", ["a"])


def test_lines_keep_lone_returns(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n\n"), (2, ""), (3, None)], "i int, t string")
    assert [r.content for r in L.from_table(df, "i", "t").sorted().collect()] == ["a", "b\rc", ""]


def test_range_state_crosses_files(spark):
    df = spark.createDataFrame([(1, "S"), (2, "x"), (3, "E\ny"), (4, "SE\nSE\nz")], "i int, t string")
    lines = L.from_table(df, "i", "t")
    masked = between_mask(lines, F.col("content").contains("S"), F.col("content").contains("E"))
    assert [r._in for r in masked.df.orderBy("_o0", "_o1").collect()] == [True, True, True, False, True, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "b" / "c.log").write_text("3\n")
    assert [r.content for r in L.from_files(spark, str(tmp_path)).sorted().collect()] == ["1", "2", "3"]
    assert [r.content for r in L.from_files(spark, str(tmp_path), include=["*.log"]).sorted().collect()] == ["3"]


def test_observed_counts(spark):
    assert observed(L.from_local(spark, ["a", "b"]), 'find "a" | count')[0] == {"stage": "find", "in": 2, "out": 1}
