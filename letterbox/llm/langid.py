"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased letters of the whole text, as square roots of their
shares, scaled to unit length. Both levels are linear support vector machines in one-versus-one pairs,
fitted on the driver by averaged stochastic subgradients on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import cut, slices

DIMENSIONS = 4096
#: labelled rows the classifier is fitted on: at most so many per language, and so many in all
PER_LANGUAGE, IN_ALL = 400, 8000
#: fixed values: families of ISO 639-1 codes; any other language is a family of its own
FAMILIES = {
    **dict.fromkeys("en de nl da sv no nb nn is af fy lb yi".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance"),
    **dict.fromkeys("ru uk be pl cs sk sl hr sr bs bg mk".split(), "slavic"),
    **dict.fromkeys("fi et hu".split(), "uralic"),
    **dict.fromkeys("tr az kk uz ky tk".split(), "turkic"),
    **dict.fromkeys("hi ur bn pa gu mr ne fa".split(), "indo-iranian"),
}
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(rb"[^a-z\x80-\xff]+")


def features(text: str) -> np.ndarray | None:
    """The unit vector of a whole text, or None where it has no letter."""
    if not _LETTER.search(text):
        return None
    raw = b" " + _OTHER.sub(b" ", text.lower().encode("utf-8", "surrogatepass")) + b" "
    counts = np.zeros(DIMENSIONS)
    for at in range(0, max(1, len(raw) - 2), 1 << 20):
        x = np.frombuffer(raw[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        if len(x) >= 3:
            key = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
            counts += np.bincount(key >> np.uint32(20), minlength=DIMENSIONS)
    out = np.sqrt(counts)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1 / 1: subgradient steps on the hinge loss in a fixed order, averaged."""
    rng, n = np.random.default_rng(0), len(y)
    z = np.hstack([x, np.ones((n, 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n
    w, total, steps = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 16)):
            steps += 1
            rate = 1 / (lam * (steps + 100))
            inside = y[rows] * (z[rows] @ w) < 1
            w = w * (1 - rate * lam) + rate / len(rows) * ((y[rows] * share[rows] * inside) @ z[rows])
            norm = np.linalg.norm(w) * np.sqrt(lam)
            if norm > 1:
                w /= norm
            if epoch >= epochs // 2:
                total += w
    w = total / max(1, steps - steps // 2)
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Votes:
    """One-versus-one machines over labels; the label with most votes wins, margins break ties."""

    labels: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Votes:
        labels = sorted(set(y))
        out = cls(labels, list(combinations(range(len(labels)), 2)))
        fits = []
        for a, b in out.pairs:
            rows = (y == labels[a]) | (y == labels[b])
            fits.append(linear_svm(x[rows], np.where(y[rows] == labels[a], 1.0, -1.0)))
        if fits:
            out.weights, out.bias = np.array([w for w, _ in fits]), np.array([b for _, b in fits])
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the label and a confidence from 0 to 1 for each row."""
        if self.weights is None:
            return np.zeros(len(x), int), np.ones(len(x))
        sure = 1 / (1 + np.exp(-4 * np.clip(x @ self.weights.T + self.bias, -10, 10)))
        votes, strength = np.zeros((len(x), len(self.labels))), np.zeros((len(x), len(self.labels)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += sure[:, k] >= 0.5
            votes[:, b] += sure[:, k] < 0.5
            strength[:, a] += sure[:, k]
            strength[:, b] += 1 - sure[:, k]
        best = np.argmax(votes + strength / (len(self.labels) + 1), axis=1)
        return best, strength[np.arange(len(x)), best] / (len(self.labels) - 1)


@dataclass
class LanguageModel:
    """Machines between families and, for each family, between its languages."""

    families: Votes
    within: dict[str, Votes]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> LanguageModel:
        family = np.array([FAMILIES.get(k, k) for k in langs])
        return cls(Votes.fit(x, family), {f: Votes.fit(x[family == f], langs[family == f]) for f in sorted(set(family))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top, score = self.families.predict(x)
        out = [""] * len(x)
        for k, family in enumerate(self.families.labels):
            rows = np.flatnonzero(top == k)
            if len(rows):
                best, sure = self.within[family].predict(x[rows])
                for r, b in zip(rows, best, strict=True):
                    out[r] = self.within[family].labels[b]
                score[rows] *= sure
        return out, score


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> LanguageModel | None:
    """Learn from the labelled rows of ``docs`` that are not held out; None where there are none.

    The sample is the rows of each language with the least hashes of doc_id: up to ``per_language``, fewer
    where more than ``in_all`` would come together (of more languages than that, the most frequent). Rows are
    counted by language first, so that only hashes near the share that is needed are ranked at all. Only
    identifiers are ranked, texts are joined after.
    """
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(in_all).collect()  # at most in_all rows
    if not counts:
        return None
    most = max(1, min(per_language, in_all // len(counts)))
    # unsigned hashes below twice the needed share: at least ``most`` texts, but for one case in far more than a million
    shares = [(r["lang"], min(1.0, (2 * most + 100) / r["n"])) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "_lang string, share double"))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("lang"))
    with_text = usable.filter(F.col("text").isNotNull()).withColumn("h", h)
    near = with_text.join(share, F.col("lang") == F.col("_lang")).filter(F.shiftrightunsigned("h", 11) < F.col("share") * 2.0**53)
    near = cut(near.select("doc_id", "lang", "text", "h"), "sample")
    ids = near.select("doc_id", "lang", F.shiftrightunsigned("h", 1).alias("h"))
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("rank") <= most)
    picked = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_own"))  # at most in_all rows
    rows = near.select("doc_id", "lang", "text").join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_own")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [(lang, v.astype(np.float16).tobytes()) for lang, v in zip(batch.column(0).to_pylist(), map(features, batch.column(1).to_pylist()), strict=True) if v is not None]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.binary())], ["lang", "vector"])

    got = sorted((r["lang"], bytes(r["vector"])) for r in rows.select("lang", "text").mapInArrow(run, "lang string, vector binary").collect())
    if not got:
        return None
    x = np.array([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    return LanguageModel.fit(x, np.array([k for k, _ in got]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from the text alone.

    Rows that repeat are judged alike, an empty table gives none, and other columns of ``docs`` are not read.
    Null texts, texts without a letter, and all texts where nothing could be learned are ``und`` at 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = [features(x) if x else None for x in batch.column(2).to_pylist()]
            rows = [k for k, v in enumerate(vectors) if v is not None]
            langs, scores = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
            if rows and model is not None:
                found, sure = model.predict(np.array([vectors[k] for k in rows]))
                for k, lang in zip(rows, found, strict=True):
                    langs[k] = lang
                scores[rows] = np.clip(sure, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
