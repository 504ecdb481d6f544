"""Stages of the pipeline and queries of the operators: whole tables, empty tables, columns that clash."""

import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm import EDGES, brute_components, brute_windows, lower

import corpus_pipeline
from lineloom.llm import bpe, decontaminate, jaccard, queries, toxicity

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, documents, labels, benchmark):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in documents], DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus():
    """Clean texts, copies that differ in a few words, benchmark passages, terms that only toxic texts hold, personal data."""
    draw = random.Random(9)
    vocabulary = [a + b + c + d for a in "bdg" for b in "aeo" for c in "lmn" for d in "iu"]
    said = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(k, said(30)) for k in range(6)]
    rows = [(i, said(40)) for i in range(100)]
    rows += [(200 + i, f"{said(20)} {('zzgrumf', 'qqblorx')[i % 2]} {said(20)}") for i in range(60)]
    for i in range(20):
        words = rows[i][1].split()
        words[draw.choice([0, 1, 38, 39])] = "other"  # few of its shingles
        rows += [(300 + i, " ".join(words)), (350 + i, rows[i][1])]
    one = lambda k: " ".join(items[k][1].split()[4:16])
    rows += [(400, f"{said(15)}. {one(0).upper()}; {said(15)}"), (401, f"{said(9)} {one(1)} {said(9)} {one(2)} {said(9)}")]
    rows += [(500, f"{said(30)} write to ann.lee@example.com or 10.20.30.40 {said(9)}"), (501, "long " * 3 + said(30_000)), *EDGES]
    labels = [(i, 1, int(200 <= i < 300)) for i, _ in rows if i is not None and (i < 100 or 200 <= i < 300)] + [(None, None, 1), (3, None, None)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("corpus"), *corpus())


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, folder):
    rows, _, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns
    assert pairs(clean) == Counter(r for r in rows if not 200 <= (r[0] or 0) < 300)

    kept = pairs(corpus_pipeline.drop_near_duplicates(spark, docs, folder))
    groups = brute_components(rows, 5, 8, 10)
    assert {i for i, _ in kept if i is not None} == {i for i, n, least in groups if i is not None and (n == 0 or i == least)}
    assert all(kept[r] for r in rows if not r[1] or not r[1].strip())

    cleaned = pairs(corpus_pipeline.decontaminate_texts(spark, docs, folder))
    wanted = Counter()
    for row in rows:
        (_, _, _, n_items, _, contaminated), = brute_windows([row], items)
        text = row[1]
        if n_items:
            words, gaps = re.findall(WORD, text), re.split(WORD, text)
            hit, w = set(), [lower(x) for x in words]
            for _, t in items:
                grams = {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)}
                hit |= {k + j for k in range(len(w) - 7) if tuple(w[k : k + 8]) in grams for j in range(8)}
            text = gaps[0] + "".join(x + g for k, (x, g) in enumerate(zip(words, gaps[1:], strict=True)) if k not in hit)
        if not contaminated:
            wanted[row[0], text] += 1
    assert cleaned == wanted and 401 not in {i for i, _ in cleaned}

    private = corpus_pipeline.replace_personal_data(spark, docs, folder)
    assert private.columns == docs.columns and private.filter("n_chars <> length(text)").isEmpty()
    found = pairs(private)
    assert [r for r in rows if r[0] != 500] == [r for r in rows if found[r]] and not any("ann.lee" in (t or "") or "10.20.30.40" in (t or "") for _, t in found)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    ids = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.encode_texts(spark, docs, folder).collect())
    assert ids == Counter((i, len(x), x) for i, t in rows for x in [tuple(library.encode_ordinary(t or ""))])


def test_run_is_its_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    row = lambda r: (r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids))
    assert Counter(map(row, got.collect())) == Counter(map(row, docs.collect()))
    left = {r.doc_id for r in got.collect()}
    assert left >= {*range(100), 400, 500, 501} and not left & {401, *range(200, 300), *range(300, 370)}


def test_held_out_texts(spark, folder):
    """Rows that no label was learned from."""
    held = [r for r in queries.op8_toxicity(spark, folder).collect() if r.held_out and r.doc_id is not None and (r.doc_id < 100 or 200 <= r.doc_id < 300)]
    assert len(held) > 15 and all(r.predicted == int(r.doc_id >= 200) == int(r.score >= 0.5) for r in held)


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, f in {**queries.queries(), "pipeline": corpus_pipeline.run}.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_columns_that_clash(spark, folder):
    rows, labels, items = corpus()
    names = ["doc", "key", "__doc", "__key", "__hit", "__n", "score", "toxic", "quality", "ids", "offsets", "gram", "w", "t", "id", "n", "class_id", "component_id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", *[F.lit("own").alias(n) for n in names])
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("*", F.lit("own").alias("doc_id"), F.lit("own").alias("gram"), F.lit("own").alias("n"))
    own = lambda df: df.filter(" and ".join(f"{n} = 'own'" for n in names)).count() == df.count() > 0 and [c for c in df.columns if c in docs.columns] == docs.columns
    assert own(decontaminate.remove(docs, items)) and own(jaccard.deduplicate(docs))
    assert decontaminate.score(docs, items).count() == jaccard.near_duplicates(docs).count() == len(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", "toxic"))
    assert toxicity.score(docs.drop("score"), model).count() == len(rows)


#: Prints the worker and the MB that it holds of its own, after a few texts and after 72 MB of them.
WORKER = """
import os, re, pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from lineloom.llm import jaccard

def held(batches):
    for batch in batches:
        kb = re.search(r"Private_Dirty: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [int(kb) >> 10]})

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
for rows in (10, 12_000):
    words = F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.xxhash64(i, "id").cast("string").substr(1, 9))
    texts = spark.range(0, rows, 1, 1).select(F.concat_ws(" ", words).alias("t"))
    jaccard.key_rows(texts, 5, 8, 10, 0).write.format("noop").mode("overwrite").save()
    print(*spark.range(0, 1, 1, 1).mapInArrow(held, "pid long, mb long").collect()[0])
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_workers_give_memory_back():
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", WORKER], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300, check=True).stdout
    (one, few), (two, many) = (map(int, line.split()) for line in said.splitlines()[-2:])
    assert one == two
    assert many - few < 10
