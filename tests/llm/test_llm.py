"""Each operator against a brute-force version or an exact round trip, on rows with nulls, repeats, ties and long texts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lineloom.llm import bpe, chat, cotrain, decontaminate, jaccard, pii, queries, rans, topk, toxicity, warc

random.seed(5)
WORDS = [f"w{i}" for i in range(60)]
EDGES = [(None, "null id"), (1, None), (2, ""), (3, "   "), (4, "a"), (4, "a"), (4, "other text"), (5, "Same Text Here and more"), (6, "same text here AND more")]
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, rows):
    """Documents with columns whose names clash with common ones."""
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], "doc_id long, text string, key string, n int, doc string")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


# near duplicates ----------------------------------------------------------------------------------------------


def brute_components(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((rows[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows)))


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_near_duplicates(spark, width, num, den):
    rows = list(EDGES)
    for k in range(40):
        base = [random.choice(WORDS) for _ in range(random.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(random.randint(1, 6)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 30))):
                copy[random.randrange(len(copy))] = random.choice(WORDS)
            rows.append((1000 - len(rows), " ".join(copy)))
    hub = [random.choice(WORDS) for _ in range(120)]
    for k in range(60):  # one group whose copies differ about as much as they may
        copy = list(hub)
        for _ in range(random.randint(1, 5)):
            copy[random.randrange(len(copy))] = f"v{k}"
        rows.append((2000 + k, " ".join(copy)))
    got = jaccard.near_duplicates(docs_of(spark, rows), width=width, num=num, den=den).collect()
    assert Counter((r.doc, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width, num, den)


def test_deduplicate_keeps_columns_and_one_row(spark):
    got = jaccard.deduplicate(docs_of(spark, EDGES)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, "null id"), (1, ""), (2, ""), (3, "   "), (4, "a"), (4, "other text"), (5, "Same Text Here and more")]
    assert got[0].__fields__ == ["doc_id", "text", "key", "n", "doc"]
    assert jaccard.deduplicate(docs_of(spark, EDGES).limit(0)).count() == 0


# decontamination ----------------------------------------------------------------------------------------------


def brute_windows(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for item, t in items:
        w = word.findall(lower(t))
        for i in range(max(1, len(w) - 7)) if w else ():
            grams[tuple(w[i : i + 8])].add(str(item))
    out = []
    for d, t in rows:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g] - {"None"}  # what has no id counts as no item
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return Counter(out)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, limit):
    items = [(10, " ".join(WORDS[:20])), (9, " ".join(WORDS[5:30])), (8, "Short one"), (7, None), (6, "..."), (None, " ".join(WORDS[40:50]))]
    rows = [*EDGES, (20, "x y " + " ".join(WORDS[3:17]) + " é"), (21, "a SHORT, one b"), (22, " ".join(WORDS[40:47])), (23, "x " * 5000 + " ".join(WORDS[41:50])), (23, " ".join(WORDS[12:26]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.score(docs_of(spark, rows), table, broadcast_bytes=limit).collect()
    wanted = brute_windows(rows, items)
    assert Counter(map(tuple, got)) == wanted and sum(w[2] > 0 for w in wanted) >= 4


def test_spans_go_and_the_rest_stays(spark):
    items = spark.createDataFrame([(1, " ".join(WORDS[:9])), (2, " ".join(WORDS[20:29]))], "item_id long, text string")
    rows = [(1, "Start, " + " ".join(WORDS[:9]) + ". End  here"), (2, "Clean; text"), (3, " ".join(WORDS[:9] + WORDS[20:29])), (4, None)]
    got = {r.doc_id: r.text for r in decontaminate.remove(docs_of(spark, rows), items).collect()}
    assert got == {1: "Start, End  here", 2: "Clean; text", 4: None}


# personal data ------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    rows = [*EDGES, (30, "Maria Lopez, Ms. Lopez; +1 (788) 555-2942 or 788-555-2942; a.b@x1.example.com A.B@X1.EXAMPLE.COM 10.20.30.40 4111 1111 1111 1111 DE89 3704 0044 0532 0130 00"), (31, "Иван Петров ﷐ 1.2.3.4 4111111111111111")]
    got = {(r.doc_id, i): r for i, r in enumerate(pii.pseudonymize(docs_of(spark, rows), "k", count_col="found").collect())}
    by_id = {r.doc_id: r for r in got.values()}
    assert [r.text for r in got.values() if r.doc_id == 1] == [None] and by_id[5].text == EDGES[7][1]
    t = by_id[30].text
    assert not any(x in t for x in ("Lopez", "555-2942", "x1.example", "10.20.30.40", "4111 1111", "3704"))
    assert re.search(r"^\w+ (\w+), Ms\. \1; \+1 \((\d{3})\) (\d{3}-\d{4}) or \2-\3; ", t) and re.search(r"([a-z0-9.]+@\S+) ([A-Z0-9.]+@\S+)", t)[1].upper() == re.search(r"([a-z0-9.]+@\S+) ([A-Z0-9.]+@\S+)", t)[2]
    card = re.search(r"(\d{4} \d{4} \d{4} \d{4})", t)[1].replace(" ", "")
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, card))) % 10 == 0 and card in by_id[31].text
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", t)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.match(r"^[А-Я]\w+ [А-Я]\w+ ﷐ ", by_id[31].text)


def test_surrogates_stay_distinct_where_few_are_free(spark):
    found = spark.createDataFrame([("ssn", f"{i:03d}-00-0000"[:3]) for i in range(400)], "kind string, canon string")
    late = {r.canon: r.attempt for r in pii.attempts(found, "k").collect()}
    assert late
    rows = spark.createDataFrame([("ssn", f"{i:03d}", late.get(f"{i:03d}", 0)) for i in range(400)], "kind string, canon string, a int")
    made = [r[0] for r in rows.select(pii.surrogate(F.col("kind"), F.col("canon"), F.col("a"), "k")).collect()]
    assert len(set(made)) == 400 and not set(made) & {f"{i:03d}" for i in range(400)}


# tokens -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(library):
    letters = list("abcstrevmld'' '  \n\t\r.,!12é漢字😀   ́ⅷ½")
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(5000)] + ["", "!" * 4000, " " * 500, "a" * 3000]
    c = bpe.Codec(MULTI)
    ids, first, offsets = c.encode(texts)
    for t, a, b in zip(texts, first, first[1:], strict=False):
        assert ids[a:b].tolist() == library.encode_ordinary(t)
        data = t.encode()
        assert c.decode(ids[a:b])[0] == data
        ends = [*offsets[a:b].tolist(), len(data)]
        assert all(c.decode(ids[a + k : a + k + 1])[0] == data[x:y] for k, (x, y) in enumerate(zip(ends, ends[1:], strict=False)))


def test_bpe_on_tables(spark, library, monkeypatch):
    rows = [*EDGES, (9, "it's  a\n\nlong text " * 400)]
    got = bpe.decode(bpe.encode(docs_of(spark, rows), MULTI), MULTI).collect()
    assert sorted((r.text or "", r.ids, bytes(r.decoded).decode(), r.key) for r in got) == sorted((t or "", library.encode_ordinary(t or ""), t or "", "x") for _, t in rows)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    assert bpe._encode_long(bpe.Codec(MULTI), rows[-1][1])[0].tolist() == library.encode_ordinary(rows[-1][1])


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 300_000])
def test_rans_blocks(n):
    for ids in (np.random.default_rng(n).zipf(1.2, n) % 50257, np.full(n, 7), np.arange(n) % 50257):
        assert (rans.decode_segment(rans.encode_segment(ids)) == ids).all()


def test_rans_checkpoints_and_checksums():
    ids = np.random.default_rng(1).zipf(1.5, 200_000) % 100
    slots = rans.frequencies(np.bincount(ids, minlength=100))
    f, c = rans._tables(slots)
    block = rans.encode_block(ids, f, c)
    symbol = np.repeat(np.arange(100, dtype=np.int32), slots)
    place = f[symbol], np.arange(1 << rans.BITS, dtype=np.uint64) - c[symbol]
    part = rans.MARK * rans.LANES
    assert (rans.decode_block(memoryview(block), 0, symbol, *place, part=1)[0] == ids[part : 2 * part]).all()
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(memoryview(bytes(broken)), 0, symbol, *place)


def test_rans_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, f"Text {i} it's <|endoftext|> é漢") for i in range(50)] + [(60, None), (61, "")]
    folder = rans.new_folder(spark)
    rans.write(docs_of(spark, rows), path, folder)
    start = 0
    for (i, text), r, s in zip(rows, rans.checksums(spark, folder).orderBy("doc").collect(), rans.read(spark, folder).orderBy("doc").collect(), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and s.ids == ids
        start += len(ids)


def test_rans_query_equals_the_unmodified_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = [(1, "a <|endoftext|> b"), (2, "plain  text"), (3, "<|endoftext|>"), (4, "x<|endoftext|><|endoftext|>\n it's"), (5, ""), (6, None), (7, "<|endoftext"), (8, "long text " * 60_000 + "<|endoftext|>")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for (i, text), r in zip(rows, queries.op10_rans_token_files(spark, str(tmp_path)).orderBy("doc_id").collect(), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# search -------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(8)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, [float("inf")] * 8), (504, [0.0] * 8), (505, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i not in (500, 501, 502, 503)]
    wanted = set()
    for q, v in good:
        if q % 50 == 0:
            found = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            wanted |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    for size in (64, 8192):
        monkeypatch.setattr(topk, "BLOCK_ROWS", size)
        assert {tuple(r) for r in topk.search(df, df.filter("vec_id % 50 = 0"), 5).collect()} == wanted
    assert topk.search(df.limit(0), df.limit(0), 5).count() == 0


def test_top_k_with_repeats(spark, monkeypatch):
    """Repeated rows and queries, and an id that a third of the rows have, against a join."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 4)]) for i in range(120)]
    rows[7] = (7, [2.0] * 4)
    rows += [rows[7]] * 4 + [rows[50], (50, rows[3][1])] + [(9, rows[9][1])] * 30 + [(9, [float(x) for x in rng.normal(0, 0.3, 4)]) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    wanted = Counter()
    for q in (0, 50, 100):
        found = sorted((-int(v @ w), i) for j, v in whole if j == q for i, w in whole if i != q)[:5]
        wanted.update((q, r, i, -s) for r, (s, i) in enumerate(found, 1))
    for size in (16, 8192):
        monkeypatch.setattr(topk, "BLOCK_ROWS", size)
        assert Counter(map(tuple, topk.search(df, df.filter("vec_id % 50 = 0"), 5).collect())) == wanted


def test_bounds_keep_the_best():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 0.1, (3000, 16))).astype(np.float32)
    b = topk.Block(np.arange(3000), x)
    for i in range(0, 3000, 60):
        wanted = np.lexsort((np.arange(3000), -(x @ x[i])))
        assert b.best(x[i], i, 5)[0].tolist() == [j for j in wanted if j != i][:5]


# toxicity, quality --------------------------------------------------------------------------------------------


def test_automaton_finds_one_edit():
    a = toxicity.Automaton(["idiot", "trash", "abc"], ["vequ"])
    alphabet = "idotrashbcvequx"

    def near(w, t):
        n = [list(range(len(t) + 1))]
        for i, c in enumerate(w, 1):
            n.append([i])
            for j, d in enumerate(t, 1):
                n[i].append(min(n[i - 1][j] + 1, n[i][j - 1] + 1, n[i - 1][j - 1] + (c != d)))
        return n[-1][-1]

    for _ in range(4000):
        base = list(random.choice(["idiot", "trash", "abc", "vequ"]))
        for _ in range(random.randint(0, 2)):
            base[random.randrange(len(base))] = random.choice(alphabet) if random.random() < 0.6 else ""
        w = "".join(base)
        if w:
            exact = w in ("idiot", "trash", "abc") or w.startswith("vequ")
            assert a.match(w) == (1 if exact else 2 if min(near(w, "idiot"), near(w, "trash")) == 1 else 0), w


def test_toxicity(spark):
    words = [a + b + c for a in "bdg" for b in "aeo" for c in "lmn"]
    good = [(i, " ".join(random.choice(words) for _ in range(40))) for i in range(120)]
    bad = [(200 + i, " ".join([*random.choices(words, k=20), random.choice(["zzgrumf", "zzblorx"]), *random.choices(words, k=20)])) for i in range(40)]
    labels = spark.createDataFrame([(i, 0) for i, _ in good] + [(i, 1) for i, _ in bad] + [(None, 1), (1, None)], "doc_id long, toxic int")
    docs = docs_of(spark, good + bad + EDGES[:4])
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] >= 0.5 for i, _ in bad) and all(got[i] < 0.5 for i, _ in good)
    s = toxicity.Scorer(toxicity.Model())
    assert s.score("you are an idiiot") > s.score("you are an idol") and s.score('they said "idiot" then') < s.score("such an idiot they are") and 0 <= s.score(None) < 0.5
    assert toxicity.fit(docs, labels.limit(0)).weights == toxicity.DEFAULT_WEIGHTS


@pytest.mark.parametrize("toxic", [1, 0])
def test_copies_hide_no_terms(spark, monkeypatch, toxic):
    """A third of the labelled rows are copies of one text with every term."""
    monkeypatch.setattr(toxicity, "TERMS", [])
    words = [a + b + c for a in "bdg" for b in "aeo" for c in "lmn"]
    terms = ["zzgrumf", "qqblorx"]
    rows = [(i, " ".join(random.choices(words, k=40)), 0) for i in range(120)]
    rows += [(200 + i, " ".join([*random.choices(words, k=20), terms[i % 2], *random.choices(words, k=20)]), 1) for i in range(60)]
    copied = " ".join([*random.choices(words, k=20), *terms, *random.choices(words, k=20)])
    rows += [(500 + i, copied, toxic) for i in range(100)]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, [r[:2] for r in rows]), labels)
    automaton = toxicity.Automaton(model.words, model.stems)
    assert [automaton.match(t) for t in terms] == [1, 1] and not any(automaton.match(w) == 1 for w in words)


def test_every_term_that_passes_is_kept(spark, monkeypatch):
    """More terms than 400, whether or not candidates are few enough to be sent to the tasks."""
    monkeypatch.setattr(toxicity, "TERMS", [])
    words = [a + b + c for a in "bdg" for b in "aeo" for c in "lmn"]
    draw = random.Random(7)
    letters = "hijkpqrstuvwxyz"
    begins = draw.sample([a + b + c for a in letters for b in letters for c in letters], 450)
    terms = [b + "".join(draw.choices(letters, k=5)) for b in begins]
    rows = [(i, " ".join(draw.choices(words, k=30)), 0) for i in range(500)]
    for i in range(500):
        mixed = [w for k in range(9) for w in (*draw.choices(words, k=2), terms[(9 * i + k) % 450])]
        rows.append((1000 + i, " ".join(mixed), 1))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    docs = docs_of(spark, [r[:2] for r in rows]).repartition(4)
    models = []
    for held in (50_000, 0):
        monkeypatch.setattr(toxicity, "HELD_TERMS", held, raising=False)
        models.append(toxicity.fit(docs, labels))
    automaton = toxicity.Automaton(models[0].words, models[0].stems)
    assert sum(automaton.match(t) == 1 for t in terms) == 450 and not any(automaton.match(w) == 1 for w in words)
    assert (models[0].words, models[0].stems) == (models[1].words, models[1].stems)


def test_co_training(spark):
    rows = []
    for i in range(300):
        fine = i % 3 != 0
        rows.append((i, " ".join(random.choice(WORDS) for _ in range(50)) + "." if fine else "%%% !! " * 30, "en", "good" if fine else "bad", 100))
    rows += [(900, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 120)] + [(5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in cotrain.co_train(docs, labels).collect()}
    assert len(got) == 301 and all((got[i] >= 0.5) == (i % 3 != 0) for i in range(300)) and 0 <= got[900] <= 1
    assert {r.score for r in cotrain.co_train(docs, labels.limit(0)).collect()} == {0.5}


# archives, dialogues ------------------------------------------------------------------------------------------


def test_merkle_audit(spark):
    rows = [(i, f"u{i}", "b" * (i % 7)) for i in range(0, 9000, 3)] + [(None, "n", "n"), (6, "u6", "bbbbbb"), (6, None, None)]
    one = spark.createDataFrame(rows, "page_id long, url string, html string")
    other = [r for r in rows if r[0] not in (30, 5001)] + [(1, "new", "x")]
    other = [(i, u, "changed") if i in (300, 8997) else (i, u, b) for i, u, b in other]
    two = spark.createDataFrame(other, "page_id long, url string, html string")
    got = {(r.id, r.kind) for r in warc.audit(warc.tree(one, "a"), warc.tree(two, "b")).collect()}
    assert got == {(30, "missing"), (5001, "missing"), (1, "extra"), (300, "changed"), (8997, "changed")}
    assert warc.audit(warc.tree(one, "a"), warc.tree(one, "a")).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "Hi <|x"), (1, 2, "bob", None), (1, 3, "ann", "é"), (1, 3, "ann", "é"), (2, 0, None, "q"), (None, None, "ann", "z"), (3, 0, "system", "alone")]
    rows += [(4, 5, "ann", f"t{i}") for i in range(300)] + [(4, 900, "bob", "last")]
    got = chat.rotate(spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn int, role string, text string, mask string")).collect()
    one = {r.perspective: r for r in got if r.conv == 1}
    assert one["ann"].text == "<|system|>S<|end|>\n<|assistant|>Hi <\\|x<|end|>\n<|user name=bob|><|end|>\n<|assistant|>é<|end|>\n"
    assert [one["ann"].text[m.start : m.stop] for m in one["ann"].mask] == ["Hi <\\|x", "é"] and [one["bob"].text[m.start : m.stop] for m in one["bob"].mask] == [""]
    assert {r.conv for r in got} == {1, 2, 4, None}
    four = [r for r in got if r.conv == 4 and r.perspective == "bob"]
    assert sum(r.n_turns for r in four) == 301 and max(r.n_turns for r in four) < 150


# forms of names, sketches, merges ---------------------------------------------------------------------------------


def test_forms_of_names(spark):
    rows = [(1, "Priya Sharma met Ahmed Khan; Mary-Ann Smith left. JOHN SMITH came, DR. SMITH too."), (2, "Maria Lopez is here. Later Lopez left. LOPEZ!"), (3, "fe80:1:2::1 at 12:30:45, 10.0.0.1"), (4, "James James and Mr James")]
    got = {r.doc_id: r.text for r in pii.pseudonymize(docs_of(spark, rows), "k").collect()}
    assert not re.search("(?i)priya|sharma|ahmed|khan|mary|smith|john", got[1])
    assert re.fullmatch(r"\w+ (\w+) is here\. Later \1 left\. (\w+)!", got[2]) and got[2].split()[1].upper() in got[2]
    assert " at 12:30:45, " in got[3] and "fe80" not in got[3] and "10.0.0.1" not in got[3]
    given, surname, _, _, again = got[4].split()
    assert surname == again and given != surname


def test_sketch_distances_are_bounds():
    base = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [np.unique(base[:n]) for n in (1, 10, 255, 256, 257, 300, 1024, 1025, 2100, 3000)]
    sketches = jaccard.parity_sketches(sets)
    words = np.array([len(s) for s in sketches])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = jaccard.sketch_distances(np.concatenate(sketches), np.cumsum(words) - words, words, a, b)
    assert all(d <= abs(len(sets[x]) - len(sets[y])) for x, y, d in zip(a, b, apart, strict=True))


def test_merges_equal_the_library():
    import tiktoken

    c = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(3)
    for _ in range(60):
        texts = ["".join(r.choice("abcXYZ 's'll \n\t\x00 12 é漢🙂Α.,-_") for _ in range(r.choice([0, 1, 9, 60, 500]))) for _ in range(5)] + ["a" * r.randint(7, 40), "\0" * r.randint(1, 20)]
        ids, first, _ = c.encode(texts)
        assert [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]
