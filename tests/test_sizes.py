"""What must not grow with tables: how often costly columns are made, and memory of workers; queries against their SQL on odd texts."""

import tracemalloc
from itertools import combinations

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lineloom.functions import scalar
from lineloom.operators import documents, graph, index, search, similarity
from lineloom.plans import catalogue
from lineloom.plans.compiler import query
from lineloom.sources import lines as sources


def by_sql(folder, name, table="documents"):
    with duckdb.connect() as c:
        c.execute("SET threads = 2")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        return sorted(c.execute(catalogue.SQL[name]).fetchall(), key=str)


def by_query(spark, folder, name):
    return sorted((tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()), key=str)


def put(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def peak_mb(function, *values):
    tracemalloc.start()
    try:
        function(*values)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_redacted_as_its_sql(spark, tmp_path):
    put(spark, tmp_path, ["38.253.197.126 4880761348116108", "aé123-45-6789é x123-45-6789", "toKen = abcdefghijkſmnopqr", "4111\x0b1111 1111 1111", "password: a_b-c.d@example.org0123456789abcdef", None, "", "a@b.co 555 123-4567"])
    assert by_query(spark, tmp_path, "redacted") == by_sql(tmp_path, "redacted")
    assert by_query(spark, tmp_path, "detections") == by_sql(tmp_path, "detections")


def test_fingerprints_in_little_memory():
    parts = pa.array([[f"some {i} shingle{j}" for j in range(300)] for i in range(1000)])
    texts = pa.array([f"{i} " * 4000 for i in range(1000)])
    assert peak_mb(similarity.simhash.func, parts) < 30 and peak_mb(similarity.minhash(32).func, parts) < 30
    assert peak_mb(similarity.chunk_boundaries(16, 0xFFF).func, texts) < 130


def test_signatures_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def signature(i):
        made.add(1)
        return [i // 2, i // 2, i // 2, i % 2]

    df = spark.range(20).select("id", signature("id").alias("s"))
    got = similarity.find_duplicates(df, "id", "s", 4, 0.75)
    assert {tuple(r) for r in got.collect()} == {(i // 2 * 2, i) for i in range(20)} and made.value == 20


ODD = ["One a. Two a b! Three? a'b-c b", None, "", "  . ! ", "same. same. same same other.\n\nÉé é漢字 😀x 漢字", "the the on onthe the", "x" * 70 + " y" * 5, "Ωmega ωμέγα 12 ٣٤ Привет мир", "licens  un License the token the", "ab", "tab\tand\x0bmore_words l'été"]


def test_words_and_trigrams_as_their_sql(spark, tmp_path):
    put(spark, tmp_path, ODD * 2)
    for name in ("cooccurrence", "degree_centrality", "tf_idf", "tf_idf_search", "keywords", "index_stats", "index_search", "index_search_regex", "search_many_patterns"):
        assert by_query(spark, tmp_path, name) == by_sql(tmp_path, name), name


def exchanges(df):
    """How often a plan deals rows out."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_what_is_shuffled_does_not_hold_words(spark):
    """One exchange brings an id's texts together; behind it words and trigrams stay where they are."""
    df = spark.createDataFrame(list(enumerate(ODD)) + [(0, "One a. a b."), (None, "b b")], "id long, text string")
    assert exchanges(index.build(df, "id", "text")) == 1 and exchanges(documents.summary(df, "id", "text", 2)) == 1
    assert exchanges(documents.keywords(df, "id", "text", 2)) <= 2
    kept = {r.id: r.word for r in documents.keywords(df, "id", "text", 1).collect()}
    assert kept[0] == "a" and None not in kept and index.build(df, "id", "text").count() == index.build(df, "id", "text").distinct().count()


def test_summary_of_an_ids_texts(spark):
    df = spark.createDataFrame([(1, "a a a. b c. b c. d e."), (2, "..."), (3, None), (4, "x. y. z."), (None, "q.")], "id long, text string")
    assert {tuple(r) for r in documents.summary(df, "id", "text", 2).collect()} == {(1, "a a a. d e."), (4, "x. y.")}


def test_scripts_drop_ascii_once(spark, tmp_path):
    texts = [*ODD, "ab漢字仮", "ab漢字", "ーカタカナ", "שלום abc", "é" * 5 + "1234567", "…", "!?", "שלום مرحبا"]
    rows = [(i, t, str(i)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert by_query(spark, tmp_path, "scripts") == by_sql(tmp_path, "scripts")
    plan = spark.range(1).select(F.lit("a").alias("t")).select(scalar.script(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(t") < len(scalar.SCRIPTS)  # only ASCII is looked for in whole texts


def test_matches_are_found_once_a_line(spark):
    plan = spark.createDataFrame([("a the b the",)], "t string").select(search.occurrences(F.col("t"), "the").alias("o"))
    assert [tuple(x) for x in plan.first().o] == [(3, 6, "the"), (9, 12, "the")]
    assert plan._jdf.queryExecution().analyzed().toString().count("split(t") == 1


def test_words_too_long_for_the_dictionary_have_no_keys(spark):
    words = spark.createDataFrame([("y" * 300,), ("catx",)], "word string")
    got = similarity.suggestions(words, spark.createDataFrame([("cat",)], "word string"))
    assert [tuple(r) for r in got.collect()] == [("catx", "cat", 1)]
    assert "longest" in got._jdf.queryExecution().optimizedPlan().toString()


def test_skip_and_take_keep_few_rows(spark):
    lines = sources.from_column(spark.range(1000, 0, -1, 4), "id", F.col("id").cast("string"))
    got = query(lines, "skip 10 | take 3")
    assert [r.content for r in got.sorted().collect()] == ["11", "12", "13"]
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert [r.content for r in query(lines, "skip 10 | find /5$/ | take 2").sorted().collect()] == ["15", "25"]
    assert [r.content for r in query(lines, "skip 997 | skip 1 | take 9").sorted().collect()] == ["999", "1000"]


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def weight(i):
        made.add(1)
        return i

    df = spark.range(20).select((F.col("id") % 5).cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"), weight("id").alias("weight"))
    assert graph.degree_centrality(df).count() == 7 and made.value == 20
    assert graph.pagerank(df, iterations=2).count() == 7 and made.value == 40


def test_keys_of_words(spark):
    words = ["banana", "banona", "aa", "a", "", "x漢y"]
    df = spark.createDataFrame([(w,) for w in words], "w string").mapInArrow(similarity._with_keys(2), "w string, key long")
    keys = {w: {r.key for r in df.filter(F.col("w") == w).collect()} for w in words}
    assert len(keys["banana"]) == len({"".join(c for i, c in enumerate("banana") if i not in g) for k in range(3) for g in combinations(range(6), k)}) and df.count() == sum(map(len, keys.values()))
    assert keys["banana"] & keys["banona"] and keys[""] <= keys["aa"] & keys["a"] and not keys["x漢y"] & keys["banana"]
