"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its hashed character 2- to 4-grams, lower-cased, with every non-letter a border. Training
(numpy, plain SGD, on the driver) uses a bounded sample of labelled rows, as counts of the n-grams of their
whole texts. Each epoch draws DRAWS new pieces of PIECE n-grams from all of every text, so that texts count alike,
whatever their lengths, and short ones are learned too. Averaging and the
linear layer commute, so a prediction sums one row of (embedding x weights) for each n-gram of the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About how many rows training takes of each language, and how many languages (the most frequent ones) it learns at
#: most: the documented bounds of the sample, which hold what the driver gets, BUCKETS counts a row at most.
ROWS_PER_LANG, LANGS = 400, 400
BUCKETS, DIMENSIONS, EPOCHS, RATE, PIECE = 1 << 15, 16, 12, 2.0, 120
#: Pieces of each text in each epoch.
DRAWS = 6


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)], bool)


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    if not points.any():
        return np.empty(0, np.int64)
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    keep = (points[1:] != 0) | (points[:-1] != 0)  # runs of borders count as one
    points = points[np.concatenate(([True], keep))]
    out = []
    h = points.copy()
    for n in (2, 3, 4):
        if len(points) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embedding times weights
    bias: np.ndarray
    temperature: float
    reject: float  # below this calibrated score a prediction counts as unsure

    def logits(self, text: str) -> np.ndarray | None:
        g = grams(text)
        if not len(g):
            return None
        if len(g) > 20_000:
            return np.bincount(g, minlength=BUCKETS) @ self.table / len(g) + self.bias
        return self.table[g].mean(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected). Ties go to the language first in order."""
        z = self.logits(text) if text else None
        if z is None or not self.langs:
            return "und", 0.0, True
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.reject)


Counts = tuple[np.ndarray, np.ndarray]


def counts_of(text: str) -> Counts:
    """(buckets, counts) of the n-grams of a whole text."""
    return np.unique(grams(text), return_counts=True)


def fit(rows: list[tuple[Counts | str, str]], seed: int = 5) -> Model:
    """Train on (text or its counts, lang) rows; one in five is held back for the temperature and the threshold of rejection."""
    counted = [(counts_of(t) if isinstance(t, str) else t, lang) for t, lang in rows if t and lang]
    counted = [(c, lang) for c, lang in counted if len(c[0])]
    langs = sorted({lang for _, lang in counted})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    counted = [counted[k] for k in rng.permutation(len(counted))]
    held = counted[: len(counted) // 5]
    taught = counted[len(counted) // 5 :]
    steps_of = {id(c): np.cumsum(c[1]) for c, _ in counted}
    draw = lambda c, n: c[0][np.searchsorted(steps_of[id(c)], rng.integers(steps_of[id(c)][-1], size=n), side="right")]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(langs))), np.zeros(len(langs))
    if taught:
        y = np.repeat([langs.index(lang) for _, lang in taught], DRAWS)
        share = np.bincount(y, minlength=len(langs)) / len(y)
        cost = 1 / np.maximum(share[y] * len(langs), 1e-3)
        steps, total = 0, EPOCHS * (len(y) // 32 + 1)
        flat, inner = emb.reshape(-1), np.arange(DIMENSIONS)
        for _ in range(EPOCHS):
            x = np.concatenate([draw(c, DRAWS * PIECE).reshape(DRAWS, PIECE) for c, _ in taught])
            order = rng.permutation(len(x))
            for k in range(0, len(order), 32):
                own = order[k : k + 32]
                rate = RATE * (1 - steps / total)
                steps += 1
                mean = emb[x[own]].mean(axis=1)
                z = mean @ weights + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), y[own]] -= 1
                p *= np.minimum(cost[own], 4)[:, None] / len(own)
                back = p @ weights.T / PIECE
                weights -= rate * mean.T @ p
                bias -= 0.1 * rate * p.sum(axis=0)
                np.add.at(flat, (x[own].reshape(-1, 1) * DIMENSIONS + inner).ravel(), (-rate * PIECE * np.repeat(back, PIECE, axis=0)).ravel())
    model = Model(langs, (emb @ weights).astype(np.float32), bias, 1.0, 0.0)
    z, y = [], []
    for c, lang in held:
        z.append(c[1] @ model.table[c[0]] / c[1].sum() + bias)
        z += [model.table[draw(c, n)].mean(axis=0) + bias for n in (4 * PIECE, PIECE)]
        y += [langs.index(lang)] * 3
    if z:
        z, y = np.array(z), np.array(y)

        def loss(t: float) -> float:
            s = z / t
            return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.1, 10, 60), key=loss)
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        top = (s / s.sum(axis=1, keepdims=True)).max(axis=1)
        right = z.argmax(axis=1) == y
        # the lowest threshold above which 99 % of the held rows are right
        order = np.argsort(-top)
        precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= 0.99)
        model.reject = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_PER_LANG) -> list[tuple[Counts, str]]:
    """(counts of the whole text, lang) of about ``rows`` rows of each of the LANGS most frequent languages, chosen by a hash
    of key and text, repeats once.

    The n-grams are counted on the executors; no text leaves them. Null languages and texts teach nothing.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGS).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, rows / r["count"]))])
    h = F.xxhash64(F.lit(29), "k", "t")
    chosen = labelled.withColumn("h", h).where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share[F.col("l")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counts_of(t.as_py()) for t in batch.column(2)]
            at, n = ([x[k].astype("<i4").tobytes() for x in made] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["h", "l", "at", "n"])

    made = chosen.select("h", "l", "t").mapInArrow(run, "h long, l string, at binary, n binary").dropDuplicates(["h", "l"])
    got = sorted(made.collect(), key=lambda r: (r["h"], r["l"]))
    return [((np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")), r["l"]) for r in got]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) from the whole text alone.

    A null text or one without a letter is "und" with score 0. Equal scores go to the language first in
    order. Repeated rows stay repeated, a null doc_id stays null, other columns (whatever their names)
    are not read; an empty table gives none. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(x.as_py()) for x in batch.column(1)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
