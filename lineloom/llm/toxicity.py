"""Toxicity scores from a lexicon that misspellings don't escape.

Lexicon terms lie in a trie. The Levenshtein automata of all terms are intersected with it: a state is the set
of (trie node, edits so far), and the states that words reach are kept, so that the intersection becomes one
deterministic automaton that gives up on most words after two or three letters. Terms may be stems (they match
the begin of a word, without edits) or words; words of FUZZY letters or more also match within one edit.

Every hit has a window of words around it. Quotation marks that enclose it or verbs of reporting near it point
to quotation, forms of address near it to abuse; the window's score scales what the hit adds.

The lexicon and the weights are learned from labelled rows: terms by how much more often they occur in toxic
than in other documents, and in how many different contexts, over all labelled texts (rows of one text and label count
once); weights by logistic regression over at most FIT_ROWS rows, those of smallest id hash.

Defined results: null and empty texts have no words and get the score of a text without hits; texts of any length are
read to their end; rows that are equal or repeat an id each get a score; labels that are null, contradictory
for an id (any toxic wins) or without a document play no part; without labels of both kinds the default lexicon and weights hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize

#: Word length from which misspellings count.
FUZZY = 5
FIT_ROWS = 20_000
#: So many candidate terms or fewer are sent to the tasks that count contexts, to leave out other words early; with more of them all words' contexts are counted and joined.
HELD_TERMS = 50_000
#: Labels of so many rows or fewer are sent to every executor (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Prefixes of words that may become stems.
STEM = (3, 7)
WINDOW = 6
#: First letters of a word by which most words are known not to match.
BEGIN = 4
#: Counts that a task holds before it hands them on.
COUNTED = 150_000
WORD = re.compile(r"[^\W\d_]+")

#: A small default lexicon, and context words.
TERMS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbécile idiota estúpido dummkopf".split()
REPORTING = frozenset("said says wrote writes quoted quotes quoting called calls reported according dit écrit sagte schrieb zitat dijo escribió".split())
ADDRESS = frozenset("you your yours youre u du dich dein sie ihr tu te toi vous votre tú usted eres".split())
QUOTES = "\"“”„«»‘’"

FEATURES = ["bias", "exact", "fuzzy", "exact_share", "quoted_share", "address_share", "any"]
#: By default a hit outside of quotation is enough.
DEFAULT_WEIGHTS = [-4.0, 1.0, 0.5, 4.0, -3.0, 1.0, 5.0]


class Automaton:
    """The Levenshtein automata (one edit) of the lexicon, intersected with its trie, made deterministic as words come."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.stem, self.word, self.long = {}, {}, set()
        for term, kind in [(w, self.word) for w in words] + [(s, self.stem) for s in stems]:
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            kind[node] = term
        for term in words:
            if len(term) >= FUZZY:  # nodes from which such a term can be reached, so that edits are tried only there
                node = 0
                self.long.add(0)
                for c in term:
                    node = self.next[node][c]
                    self.long.add(node)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        grown = set(items)
        for node, edits in items:  # a letter of the term is missing in the word
            if edits == 0 and node in self.long:
                grown |= {(n, 1) for n in self.next[node].values() if n in self.long}
        key = frozenset((n, e) for n, e in grown if e == 0 or (n, 0) not in grown)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        to = set()
        for node, edits in self.sets[state]:
            if c in self.next[node] and (edits == 0 or self.next[node][c] in self.long):
                to.add((self.next[node][c], edits))
            if edits == 0 and node in self.long:
                to.add((node, 1))  # a letter too many
                to |= {(n, 1) for n in self.next[node].values() if n in self.long}  # another letter
        return self._state(to)

    def alive(self, begin: str) -> bool:
        """Whether a word that begins like this may match."""
        state = self.begin
        for c in begin:
            items = self.sets[state]
            if any(e == 0 and n in self.stem for n, e in items):
                return True
            moves = self.moves[state]
            if (to := moves.get(c)) is None:
                to = moves[c] = self._move(state, c)
            state = to
        return bool(self.sets[state])

    def match(self, word: str) -> int:
        """0: no term, 1: a term or stem, 2: a misspelled term."""
        state = self.begin
        for c in word:
            moves = self.moves[state]
            if (to := moves.get(c)) is None:
                to = moves[c] = self._move(state, c)
                if len(self.sets) > 200_000:  # what words have brought up is bounded; it comes back as needed
                    word_, self.states, self.sets, self.moves = word, {}, [], []
                    self.begin = self._state({(0, 0)})
                    return self.match(word_)
            state = to
            items = self.sets[state]
            if not items:
                return 0
            if any(e == 0 and n in self.stem for n, e in items):
                return 1
        if any(e == 0 and n in self.word for n, e in items):
            return 1
        return 2 if any(n in self.word and len(self.word[n]) >= FUZZY for n, _ in items) else 0


@dataclass
class Model:
    words: list[str] = field(default_factory=lambda: list(TERMS))
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: list(DEFAULT_WEIGHTS))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.automaton = Automaton(model.words, model.stems)
        self.weights = [float(w) for w in model.weights]
        self.known: dict[str, int] = {}
        self.alive: dict[str, bool] = {}

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, bool, bool]], int]:
        """(begin, end, kind, quoted, addressed) of every hit, and the number of words."""
        known, alive, match = self.known, self.alive, self.automaton.match
        if len(known) > 100_000:
            known.clear()
        if len(alive) > 200_000:
            alive.clear()
        lowered = text.lower()
        words = WORD.findall(lowered)
        n = len(words)
        begins = [w[:BEGIN] for w in words]
        for b in set(begins):  # most words end with their first letters
            if b not in alive:
                alive[b] = self.automaton.alive(b)
        found = []
        for i in [i for i, b in enumerate(begins) if alive[b]]:
            w = words[i]
            if (kind := known.get(w)) is None:
                kind = known[w] = match(w)
            if kind:
                found.append((i, kind))
        if not found:
            return [], n
        spans = [m.span() for m in WORD.finditer(lowered)]
        out = []
        for i, kind in found:
            a, b = spans[max(0, i - WINDOW)][0], spans[min(n - 1, i + WINDOW)][1]
            begin, end = spans[i]
            around = [lowered[x:y] for x, y in spans[max(0, i - WINDOW) : i + WINDOW + 1]]
            before, after = lowered[a:begin], lowered[end:b]
            enclosed = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            out.append((begin, end, kind, enclosed or any(w in REPORTING for w in around), any(w in ADDRESS for w in around)))
        return out, n

    def features(self, text: str | None) -> list[float]:
        hits, n = self.hits(text or "")
        exact, fuzzy = sum(k == 1 for _, _, k, _, _ in hits), sum(k == 2 for _, _, k, _, _ in hits)
        share = lambda x: x / len(hits) if hits else 0.0
        return [1.0, math.log1p(exact), math.log1p(fuzzy), min(1.0, 20 * exact / n) if n else 0.0, share(sum(q for *_, q, _ in hits)), share(sum(a for *_, a in hits)), float(exact > 0)]

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(min(700.0, -sum(w * x for w, x in zip(self.weights, self.features(text), strict=True)))))


def _terms(texts: DataFrame) -> DataFrame:
    """term, stem, n: in how many rows a word, or a prefix of words, occurs. Counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = Counter(), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*words, *stems], pa.string()), pa.array([False] * len(words) + [True] * len(stems), pa.bool_()), pa.array([*words.values(), *stems.values()], pa.int64())], names=["term", "stem", "n"])
            words.clear()
            stems.clear()
            return made

        for batch in batches:
            for text in batch["text"]:
                own = set(WORD.findall((text.as_py() or "").lower()))
                words.update(own)
                stems.update({w[:k] for w in own for k in range(STEM[0], min(STEM[1], len(w)) + 1)})
                if len(words) + len(stems) > COUNTED:
                    yield out()
        if words or stems:
            yield out()

    return map_arrow(texts.select("text"), run, "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))


def _held(terms: DataFrame) -> tuple[set[str], set[str]] | None:
    """The words and the stems among terms, if they are few enough to be sent to the tasks."""
    rows = terms.select("term", "stem").limit(HELD_TERMS + 1).collect()
    if len(rows) > HELD_TERMS:
        return None
    return {r["term"] for r in rows if not r["stem"]}, {r["term"] for r in rows if r["stem"]}


def _distinct(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """One row of each text and label, and how many of them are toxic and not. texts: text, toxic, and hash and row, which tell texts and rows apart."""
    firsts = materialize(texts.groupBy("hash", "toxic").agg(F.min("row").alias("row")), "toxicity-distinct")
    sums = {r["toxic"]: r["count"] for r in firsts.groupBy("toxic").count().collect()}
    rows = firsts.select("row")
    kept = texts.join(F.broadcast(rows) if sum(sums.values()) <= BROADCAST_ROWS else rows, "row", "left_semi")
    return kept.select("text", "toxic"), sums.get(1, 0), sums.get(0, 0)


def _contexts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (term, stem, ...) with contexts: in how many different pairs of neighbouring words each occurs. Hashes stand for pairs."""
    words, stems = _held(terms) or (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, bool, str]] = set()

            def out() -> pa.RecordBatch:
                rows = list(found)
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string())], names=["term", "stem", "context"])

            for text in batch["text"]:
                w = ["", *WORD.findall((text.as_py() or "").lower()), ""]
                for i in range(1, len(w) - 1):
                    context = f"{w[i - 1]} {w[i + 1]}"
                    if words is None or w[i] in words:
                        found.add((w[i], False, context))
                    found.update((t, True, context) for k in range(STEM[0], min(STEM[1], len(w[i])) + 1) if (t := w[i][:k]) and (stems is None or t in stems))
                if len(found) > 100_000:
                    yield out()
            yield out()

    pairs = map_arrow(texts, run, "term string, stem boolean, context string").select("term", "stem", F.xxhash64("context").alias("context")).distinct()
    return terms.join(pairs.groupBy("term", "stem").agg(F.count("*").alias("contexts")), ["term", "stem"])


def _lexicon(terms: list, n1: int, n0: int) -> tuple[list[str], list[str]]:
    """Terms that mark toxic rows; of stems that lie in one another the one that says most."""
    def weight(r) -> float:
        return r["n1"] * np.log(((r["n1"] + 0.5) / (n1 + 1)) / ((r["n0"] + 0.5) / (n0 + 1)))

    begins = lambda term: {term[:k] for k in range(1, len(term) + 1)}
    words: list[str] = []
    stems: dict[str, None] = {}
    word_begins: set[str] = set()
    stem_begins: set[str] = set()
    for r in sorted(terms, key=lambda r: (-round(weight(r), 6), r["stem"], -len(r["term"]), r["term"])):
        term = r["term"]
        if not begins(term).isdisjoint(stems) or (r["stem"] and (term in stem_begins or term in word_begins)):
            continue
        if r["stem"]:
            stems[term] = None
            stem_begins |= begins(term)
        else:
            words.append(term)
            word_begins |= begins(term)
    return words, list(stems)


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights by Newton's method with a small ridge, towards the default where the labels show no quotation or address."""
    prior = np.array([w if name in ("quoted_share", "address_share") else 0.0 for name, w in zip(FEATURES, DEFAULT_WEIGHTS, strict=True)])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 0.1
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, min_rows: int = 8) -> Model:
    """A model from all labelled rows. What reaches the driver is the terms that pass all tests, up to HELD_TERMS candidates and at most fit_rows rows of features."""
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("marked")).agg(F.max(label_col).cast("int").alias("toxic"))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    texts = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, F.col("id") == F.col("marked")).select("id", "text", "toxic", F.md5(F.col("text").cast("binary")).alias("hash"), F.monotonically_increasing_id().alias("row")), "toxicity-labelled")
    different, n1, n0 = _distinct(texts)
    if not n1 or not n0:
        return Model()
    gain = F.log(((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1)))
    # a marking term is toxic nearly wherever it occurs, beyond what chance gives among so many terms
    often = materialize(_terms(different.filter("toxic = 1")).filter(F.col("n") >= max(3, min(min_rows, n1 // 50))).select("term", "stem", F.col("n").alias("n1")), "toxicity-often")
    elsewhere = _terms(different.filter("toxic = 0")).select("term", "stem", F.col("n").alias("n0"))
    both = often.join(elsewhere, ["term", "stem"], "left").select("term", "stem", "n1", F.coalesce("n0", F.lit(0)).alias("n0"))
    counted = materialize(both.filter((F.col("n1") >= 9 * F.col("n0")) & (gain * F.col("n1") >= 14)), "toxicity-terms")
    marking = _contexts(different.filter("toxic = 1").select("text"), counted).filter(F.col("contexts") >= F.greatest(F.lit(3.0), 0.3 * F.col("n1")))
    words, stems = _lexicon(marking.collect(), n1, n0)
    model = Model(sorted({*words, *TERMS}), sorted(stems))
    # a share of the rows by their hash, so that no task gathers texts; only features are cut to fit_rows exactly
    share = min(1.0, 1.1 * fit_rows / texts.count())
    rows = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    known = featurize(rows, model, text_col="text").select("features", "toxic", F.xxhash64("id").alias("h")).orderBy("h").limit(fit_rows).select("features", "toxic").toPandas()
    if known["toxic"].nunique() == 2:
        # planted misspellings are rare in what is labelled: a misspelled hit counts at least half of a true one
        x, y = np.array(known["features"].tolist()), known["toxic"].to_numpy(float)
        model.weights = _logistic(x, y)
        model.weights[2] = max(model.weights[2], 0.5 * model.weights[1])
    return model


def _mapped(docs: DataFrame, model: Model, name: str, kind: T.DataType, value, text_col: str) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([value(scorer, t.as_py()) for t in part[text_col]], T_ARROW[kind.simpleString()])
                yield pa.RecordBatch.from_arrays([part[f.name] for f in kept] + [made], names=[f.name for f in kept] + [name])

    return map_arrow(docs, run, T.StructType([*kept, T.StructField(name, kind)]))


T_ARROW = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def featurize(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    return _mapped(docs, model, "features", T.ArrayType(T.DoubleType()), lambda s, t: s.features(t), text_col)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    return _mapped(docs, model, score_col, T.DoubleType(), lambda s, t: s.score(t), text_col)


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
