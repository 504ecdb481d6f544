import base64
import collections
import hashlib
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lineloom.functions import scalar, text_rules
from lineloom.operators import graph, logs, records, rules, search, similarity, spans, table, timeline, transform
from lineloom.plans import catalogue
from lineloom.sources import lines as L
from lineloom.streaming import stream


def values(df):
    return [tuple(r) for r in df.collect()]


def test_search_columns_are_bytes(spark):
    found = search.search(L.from_local(spark, ["éa a", "b"]), [search.build("a", "literal")], after=1)
    assert [(r.begin, r.stop, r.byte_offset) for r in found.orderBy("begin").collect()] == [(3, 4, 2), (5, 6, 4)]


def test_transform_chain(spark):
    lines = L.from_local(spark, ["foo", "bar", "baz"])
    chain = [transform.parse_substitution("s/o/0/"), transform.Command("delete", "bar"), transform.Command("after", "baz", "end")]
    assert [r.content for r in transform.result(lines, chain).orderBy("source_line", "place").collect()] == ["f0o", "baz", "end"]
    assert {r.change_type for r in transform.change_log(lines, chain).collect()} == {"substitute", "deletion", "insertion"}


def test_records(spark):
    found = records.records(L.from_local(spark, [" a 1", "b 2"]), [records.Rule(), records.Rule(pattern="b", fields=(2, 9), computed={"n": lambda f: F.size(f).cast("string")})])
    assert [(r.nr, r.nf, r.rule, r.fields) for r in found.orderBy("nr", "rule").collect()] == [(1, 2, 0, ["a", "1"]), (2, 2, 0, ["b", "2"]), (2, 2, 1, ["2", ""])]


def test_table_null_keys_join(spark):
    a, b = spark.createDataFrame([(None, 1), ("1", 2)], "k string, x int"), spark.createDataFrame([(None, 3), (1, 4)], "k int, y int")
    assert sorted(values(table.inner_join(a, b, "k", "k").select("x", "r_y"))) == [(1, 3), (2, 4)]


def test_numbers(spark):
    cases = ["1", ".5", "5.", "1e5", "+5", "-inf", "NaN", "1d", " 5 ", "0x1", ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(text_rules.number(F.col("c"))).collect()]
    assert got[:6] == [1.0, 0.5, 5.0, 1e5, 5.0, float("-inf")] and got[6] != got[6] and got[7:] == [None] * 4


def test_shown(spark):
    cases = [60.0, 0.1, 1e10, 1e-7, float("inf"), 1e20]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c double").select(text_rules.shown(F.col("c"))).collect()] == ["60", "0.1", "10000000000", "0.0000001", "inf", "100000000000000000000"]


def test_timeline(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z a",), ("1704067500 b",), ("x",)], "content string")
    b = timeline.buckets(timeline.events_of(df), "minute")
    assert b.count() == 6 and values(timeline.gaps(b).select("buckets")) == [(4,)]
    assert timeline.sparkline(b).first()[0] == "█▁▁▁▁█"


def test_log_formats(spark):
    lines = ['{"Level":"WARNING","msg":"m","x":1}', 'level=error msg="a b" k=v', "Jan  2 03:04:05 host app[12]: fatal thing", '1.2.3.4 - - [01/Jan/2024] "GET /x HTTP/1.1" 503 12', "nothing"]
    got = logs.parse_all(spark.createDataFrame([(x,) for x in lines], "content string")).select("record.format", "record.severity", "record.message").collect()
    assert [tuple(r) for r in got] == [("json", "warn", "m"), ("key=value", "error", "a b"), ("syslog", "fatal", "fatal thing"), ("access", "error", "GET /x → 503"), (None, None, None)]


def test_similarity(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("", "a"), ("same", "same")], "a string, b string")
    got = df.select(F.round(similarity.jaro(F.col("a"), F.col("b")), 4), similarity.damerau_levenshtein(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.9444, 1), (0.0, 1), (1.0, 0)]
    assert [r[0] for r in spark.createDataFrame([("Robert",), ("Ashcraft",), ("",)], "w string").select(similarity.soundex(F.col("w"))).collect()] == ["R163", "A226", "0000"]
    assert similarity.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "a string, b string")
    assert {r[0] for r in graph.cycles(edges).collect()} == {"a", "b", "c"}
    ranks = graph.pagerank(edges.withColumn("weight", F.lit(1.0)), iterations=5)
    wanted = dict.fromkeys("abcd", 0.25)
    for _ in range(5):
        wanted = {n: 0.15 / 4 + 0.85 * sum(wanted[a] for a, b in ("ab", "bc", "ca", "da") if b == n) for n in wanted}
    assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx(wanted)


def test_rules(spark):
    df = spark.createDataFrame([("mail a.b@c.org now",)], "content string")
    assert df.select(rules.redacted(F.col("content"))).first()[0] == "mail [EMAIL] now"
    moves = [rules.Transition("a", "x", "b", "hit"), rules.Transition("b", "y", "a")]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("xyzx")], "k int, i int, c string")
    assert [(r.state, r.emitted) for r in rules.machine(rows, "k", "i", "c", "a", moves).orderBy("at").collect()] == [("b", "hit"), ("a", None), ("a", None), ("b", "hit")]


def test_spans(spark):
    df = spark.createDataFrame([(1, 1, "x", 0, 5), (1, 2, "x", 4, 9), (1, 3, "x", 9, 10), (1, 4, "y", 20, 21)], "doc_id int, id int, label string, start long, end long")
    assert values(spans.overlaps(df).select("a", "b")) == [(1, 2)]
    assert sorted(values(spans.merged(df).select("start", "end"))) == [(0, 10), (20, 21)]


def test_scalar(spark):
    df = spark.createDataFrame([("HTTPServerName_x", "http://A.co.uk:80/p?b=2&a=1#f")], "w string, u string")
    got = df.select(scalar.cased(F.col("w"), "snake"), scalar.cased(F.col("w"), "camel"), scalar.normalized_url(F.col("u")), scalar.registered_domain(scalar.url_part(F.col("u"), "host")), scalar.url_encode(F.lit("a b*~")), scalar.duration_text(F.lit(90061))).first()
    assert tuple(got) == ("http_server_name_x", "httpServerNameX", "http://a.co.uk/p?a=1&b=2#f", "a.co.uk", "a%20b%2A~", "1d 1h 1m 1s")
    ips = spark.createDataFrame([("::1",), ("1:2:3:4:5:6:7:8",), ("1::2::3",), ("12345::",)], "x string")
    assert [r[0] for r in ips.select(scalar.is_valid(F.col("x"), "ipv6")).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(scalar.query_map(F.col("u"))).collect()] == [{"b": "2", "a": "1"}]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a 1\nb 2\na 3\n")
    out = stream.query_stream(stream.lines_from(spark, str(tmp_path)), 'find "a" | select 2')
    q = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.content for r in spark.table("streamed").collect()) == ["1", "3"]
    with pytest.raises(ValueError, match="order"):
        stream.query_stream(stream.lines_from(spark, str(tmp_path)), "take 1")


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in spans.systematic(df, 10, 3, "k").orderBy("k").collect()] == list(range(3, 100, 10))
    assert spans.random_sample(df, 7, 1, "k").count() == 7


def test_entry_has_sql_for_known_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.match(r"\w+$", n) for n in entry.queries())


def test_codecs_see_whole_texts(spark, tmp_path):
    texts = ["x" * 60 + "é漢😀 tail ~*+", "x" * 60 + "other", "", "a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["codecs"](spark, str(tmp_path)).orderBy("doc_id").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [tuple(r)[1:] for r in got] == [(sha(base64.b64encode(t.encode()).decode()), sha(t.encode().hex()), sha(urllib.parse.quote(t, safe="~"))) for t in texts]


def test_graph_and_fuzzy_queries_read_whole_tables(spark, tmp_path):
    texts = ["a b c a", "b d", "c e a b", "f"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = [f"Customer#{i:09d}" for i in range(60)]
    spark.createDataFrame([(n,) for n in names], "c_name string").write.parquet(f"{tmp_path}/customer.parquet")

    def weights(window):
        found = collections.Counter()
        for w in map(str.split, texts):
            found.update(tuple(sorted((w[i], y))) for i in range(len(w)) for y in w[i + 1 : i + 1 + window] if y != w[i])
        return collections.Counter({k: n for (a, b), n in found.items() for k in ((a, b), (b, a))})

    one, two = weights(1), weights(2)
    nodes = {a for a, _ in one}
    wanted = {n: sum(w for (a, _), w in one.items() if a == n) / (len(nodes) - 1) for n in nodes}
    assert dict(values(catalogue.QUERIES["degree_centrality"](spark, str(tmp_path)))) == pytest.approx(wanted)
    nodes = {a for a, _ in two}
    out = {n: sum(w for (a, _), w in two.items() if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[a] * w / out[a] for (a, b), w in two.items() if b == n) for n in nodes}
    assert dict(values(catalogue.QUERIES["pagerank"](spark, str(tmp_path)))) == pytest.approx(rank)
    assert catalogue.QUERIES["fuzzy_search"](spark, str(tmp_path)).first()[0] == names[42]
