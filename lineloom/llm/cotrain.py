"""Quality scores by co-training on two views of a page.

The text view sees what is written (shares of symbols, capitals, repeated words and lines, ...), the metadata view
what is known about the page (language, source, length). Each view has a logistic classifier. In every round each
view labels the unlabelled documents that it is most sure of, and the other view learns from them. In the end each
view is calibrated on labelled rows that took no part in training, and the calibrated log-odds are combined.

Fitted on bounded samples: at most FIT_ROWS labelled rows, and PSEUDO rows for each view, class and round, those of
smallest hash among all documents that the view is sure of. Every document is scored in every round and at the end.

Defined results: null and empty texts have the features of an empty text; null metadata is a value of its own; null ids
and repeated rows are scored like others; null labels and labels without a document play no part; labels that contradict
each other for an id count as the smaller; without labels of both kinds every score is 0.5; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

FIT_ROWS, PSEUDO, ROUNDS, SURE = 20_000, 400, 3, 0.95
#: Buckets for the values of a categorical column.
BUCKETS = 16
_WORDS = re.compile(r"\w+")


def text_features(text: str | None) -> list[float]:
    text = text or ""
    n = max(1, len(text))
    words = _WORDS.findall(text)
    lowered = [w.lower() for w in words]
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    pairs = list(zip(lowered, lowered[1:], strict=False))
    unique = lambda x: len(set(x)) / max(1, len(x))
    marks = len(re.findall(r"[^\w\s.,;:'’-]", text))
    return [letters / n, capitals / max(1, letters), marks / n, marks / w, unique(lowered), unique(pairs), unique(lines) if lines else 1.0, sum(a == b for a, b in pairs) / w, sum(map(len, words)) / w / 10, np.log1p(w) / 10, text.count("|") / w, text.count("!") / w, len(re.findall(r"\d", text)) / n, sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / max(1, len(lines)), len(re.findall(r"[.!?]", text)) / w, len(lines) / w]


def meta_features(values: list, length: float | None) -> list[float]:
    """Categorical values in buckets, and the logarithm of the length."""
    out = []
    for v in values:
        one = [0.0] * BUCKETS
        one[zlib.crc32(str(v).encode()) % BUCKETS] = 1.0
        out += one
    size = np.log1p(max(0.0, length or 0.0)) / 10
    return [*out, size, size * size]


def features(docs: DataFrame, text_col: str, categories: list[str], length_col: str) -> DataFrame:
    """docs without its text, with the arrays view_text and view_meta."""
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "view_text", "view_meta")]
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = pa.array([text_features(t.as_py()) for t in part[text_col]], kind)
                meta = pa.array([meta_features([part[c][i].as_py() for c in categories], part[length_col][i].as_py()) for i in range(part.num_rows)], kind)
                yield pa.RecordBatch.from_arrays([part[f.name] for f in kept] + [text, meta], names=[f.name for f in kept] + ["view_text", "view_meta"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("view_text", T.ArrayType(T.DoubleType())), T.StructField("view_meta", T.ArrayType(T.DoubleType()))]))


class Logistic:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.clip((x - self.mean) / self.std, -6, 6), np.ones((len(x), 1))), axis=1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.weights

    def column(self, view: str) -> Column:
        """The log-odds as a column."""
        n = len(self.mean)
        terms = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(view)[i] - float(self.mean[i])) / float(self.std[i]))) * float(self.weights[i]) for i in range(n) if self.weights[i]]
        return sum(terms, F.lit(float(self.weights[n])))


def _matrix(rows: list, view: str) -> np.ndarray:
    return np.array([r[view] for r in rows], float)


def co_train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", categories: tuple[str, ...] = ("lang", "source"), length_col: str = "n_chars") -> DataFrame:
    """docs without its text, with text_odds and meta_odds (calibrated) and score (the combined probability of label 1)."""
    rest = [c for c in docs.columns if c != text_col]
    seen = materialize(features(docs, text_col, list(categories), length_col), "cotrain-features")
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    known = seen.join(marks, seen[id_col] == F.col("__id"))
    total = known.count()
    share = int(min(1.0, 1.1 * FIT_ROWS / max(total, 1)) * 1_000_000) + 1
    known = known.filter(F.pmod(F.xxhash64("__id", "view_text"), F.lit(1_000_000)) < share)
    rows = known.select("view_text", "view_meta", "__label", (F.pmod(F.xxhash64("__id"), F.lit(5)) == 0).alias("apart")).orderBy(F.xxhash64("__id", "view_text")).limit(FIT_ROWS).collect()
    own, apart = [r for r in rows if not r["apart"]], [r for r in rows if r["apart"]]
    if any(len({r["__label"] for r in part}) < 2 for part in (own, apart)):
        return seen.select(*rest, F.lit(0.0).alias("text_odds"), F.lit(0.0).alias("meta_odds"), F.lit(0.5).alias("score"))
    free = materialize(seen.join(marks, seen[id_col] == F.col("__id"), "left_anti").select("view_text", "view_meta"), "cotrain-unlabelled")
    views = ("view_text", "view_meta")
    taught: dict[str, tuple[list, list]] = {v: (list(own), [r["__label"] for r in own]) for v in views}
    models = {v: Logistic(_matrix(own, v), np.array(taught[v][1], float)) for v in views}
    for r in range(ROUNDS):
        limit = float(np.log(SURE / (1 - SURE)))
        for view, other in (views, views[::-1]):
            odds = models[view].column(view)
            for label, sure in ((1, odds >= limit), (0, odds <= -limit)):
                found = free.filter(sure).select(*views).distinct().orderBy(F.xxhash64(F.lit(r), *views), *views).limit(PSEUDO).collect()
                taught[other][0].extend(found)
                taught[other][1].extend([label] * len(found))
        models = {v: Logistic(_matrix(taught[v][0], v), np.array(taught[v][1], float)) for v in views}
    truth = np.array([r["__label"] for r in apart], float)
    raw = {v: models[v].odds(_matrix(apart, v)) for v in views}
    calibrated = {v: Logistic(raw[v][:, None], truth) for v in views}
    both = np.stack([calibrated[v].odds(raw[v][:, None]) for v in views], axis=1)
    final = Logistic(both, truth)
    scored = seen
    for v, name in zip(views, ("text_odds", "meta_odds"), strict=True):
        scored = scored.withColumn("__raw", F.array(models[v].column(v))).withColumn(name, calibrated[v].column("__raw"))
    scored = scored.withColumn("__both", F.array("text_odds", "meta_odds"))
    return scored.select(*rest, "text_odds", "meta_odds", (1 / (1 + F.exp(-final.column("__both")))).alias("score"))
