"""Fingerprints, duplicates and suggestions against brute force; groups behind descending sorts; times between events."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lineloom.operators import similarity, timeline
from lineloom.plans.compiler import query
from lineloom.sources import lines as L


def test_rolling_hashes():
    draw = random.Random(1)
    items = [bytes(draw.choices(range(256), k=n)) for n in (0, 1, 7, 8, 9, 300, 300)] + [b"\xff" * 50]
    for size in (1, 8, 40):
        wanted = []
        for data in items:
            h, top, out = 0, 1, []
            for _ in range(size - 1):
                top = (top * 257 % 2**64) % (2**61 - 1)
            for k, b in enumerate(data):
                if k >= size:
                    h = (h + 2**61 - 1 - (data[k - size] * top % 2**64) % (2**61 - 1)) % (2**61 - 1)
                h = ((h * 257) % 2**64 + b) % 2**64 % (2**61 - 1)
                out.append(h)
            wanted.append(out[size - 1 :])
        assert [h.tolist() for h in similarity.rolling_hashes(items, size)] == wanted


def test_find_duplicates(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(12):
        base = [draw.randrange(50) for _ in range(16)]
        for _ in range(draw.randint(1, 12)):
            s = list(base)
            for _ in range(draw.randint(0, 5)):
                s[draw.randrange(16)] = draw.randrange(50, 99)
            rows.append(s)
    draw.shuffle(rows)
    rows += [rows[0]] * 40
    table = [(i, s) for i, s in enumerate(rows)] + [(None, rows[0]), (999, None)]
    wanted, taken = set(), set()
    for i, a in enumerate(rows):
        if i not in taken:
            group = [j for j in range(i + 1, len(rows)) if j not in taken and sum(x == y for x, y in zip(a, rows[j], strict=True)) >= 12]
            taken.update(group)
            wanted |= {(i, j) for j in (i, *group)} if group else set()
    df = spark.createDataFrame(table, "doc long, sig array<long>")
    got = similarity.find_duplicates(df, "doc", "sig", 16, 0.75).collect()
    assert len(got) == len(wanted) and {(r.leader, r.id) for r in got} == wanted
    assert similarity.find_duplicates(df.limit(0), "doc", "sig", 16, 0.75).count() == 0


def test_fingerprints(spark):
    texts = ["the quick brown fox jumps", "one two", "", None, "a b c a b c a b c é"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").transform(similarity.shingled, "t", 3, "p")
    for r in got.select("i", similarity.simhash("p").alias("s"), similarity.minhash(8)("p").alias("m")).collect():
        w = (texts[r.i] or "").lower().split()
        parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
        hashes = [similarity.fnv1a(x.encode()) for x in parts]
        bits = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)
        assert r.s % 2**64 == bits
        assert [x % 2**64 for x in r.m] == [min((similarity.fnv1a(x.encode(), seed) for x in parts), default=2**64 - 1) for seed in range(8)]


def test_suggestions(spark):
    draw = random.Random(3)
    known = ["".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(40)] + ["x" * 60]
    unknown = ["".join(draw.choices("abcd", k=draw.randint(1, 6))) for _ in range(60)] + ["y" * 300, "x" * 61]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            now = [i]
            for j, e in enumerate(b, 1):
                now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (c != e)))
            last = now
        return last[-1]

    table = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {(r.word, r.suggestion): r.distance for r in similarity.suggestions(table(unknown), table(known), top=1000).collect()}
    assert got == {(u, k): n for u in set(unknown) - set(known) for k in known if (n := distance(u, k)) <= 2}


def test_shared_shingles(spark):
    docs = [(1, "a b c d"), (2, "b c d e f"), (3, None), (4, "a b"), (5, "c d e c d e")]
    items = [(7, "B C D e"), (8, None), (9, "x y z")]
    schema = "text string, n int"
    got = similarity.shared_shingles(spark.createDataFrame([(i, t, 0) for i, t in docs], f"doc long, {schema}"), "doc", spark.createDataFrame([(i, t, 0) for i, t in items], f"item long, {schema}"), "item", "text", 3)
    assert {(r.doc, r.item, round(r.jaccard, 6)) for r in got.collect()} == {(1, 7, 0.333333), (2, 7, 0.666667), (5, 7, 0.25)}


def test_groups_behind_a_descending_sort(spark):
    rows = ["b,1", "a,3", "b,3", "c,2", "a,2", "c,3", "b,1"]
    lines = query(L.from_local(spark, rows), 'set separator "," | sort by field 2 desc numeric | group by field 1 aggregate count, freq 2, distinct 2')
    assert [r.content for r in lines.sorted().collect()] == ["a\t2\t2:1;3:1\t2", "b\t3\t1:2;3:1\t2", "c\t2\t2:1;3:1\t2"]
    twice = query(L.from_local(spark, rows), 'set separator "," | sort by field 1 desc | sort by field 2 numeric | group by field 1 aggregate count')
    assert [r.content for r in twice.sorted().collect()] == ["b\t3", "c\t2", "a\t2"]


def test_durations(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["k", "l", None]), draw.choice([5, 5, draw.randrange(20_000), draw.randrange(9_000_000)])) for _ in range(300)] + [("k", None), ("m", 4)]
    df = spark.createDataFrame(rows, "key string, ts long")
    for key in (None, "key"):
        wanted = Counter()
        for k in {r[0] for r in rows} if key else {0}:
            times = sorted(t for j, t in rows if t is not None and (key is None or j == k))
            wanted.update(float(b - a) for a, b in zip(times, times[1:], strict=False))
        assert {r.d: r.n for r in timeline.durations(df, "ts", key).collect()} == dict(wanted)
    assert timeline.duration_histogram(df, 5, key="key").agg(F.sum("n")).first()[0] == sum(wanted.values())
    assert timeline.duration_histogram(df.limit(0), 5).count() == 0


def test_chunk_boundaries(spark):
    got = spark.createDataFrame([("abcdefgh" * 40,), (None,), ("ab",)], "t string").select(similarity.chunk_boundaries(4, 0x3)("t").alias("b")).collect()
    hashes = similarity.rolling_hashes([b"abcdefgh" * 40], 4)[0]
    assert got[0].b == (np.flatnonzero(hashes % 4 == 0) + 4).tolist() and [got[1].b, got[2].b] == [[], []]
