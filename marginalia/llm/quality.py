"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are hashed trigrams of a text's shape (letters, capitals, digits, each sign) and a few coarse
measures (repetition, word and line lengths), weighted by tf-idf. A truncated SVD of a bounded
labelled sample gives the latent vectors; those of the sample are broadcast (its size bounds them)
and every document is compared to all of them with exact cosine products, in blocks. The nearest
vote with their label, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are fitted: the documented bound of the sample and of what is broadcast.
SAMPLE_ROWS = 4000
BUCKETS, DIMENSIONS, NEIGHBOURS, BLOCK = 1 << 13, 48, 15, 256
ACCEPT = 0.3
#: Cosines this close are equal: what shares a block changes the last bits of a product.
TIE = 1e-6


def _shape_table() -> np.ndarray:
    """Shape class of each code point below 0x250: ASCII signs stand for themselves."""
    out = np.full(0x250, 3, np.int64)
    for c in range(0x250):
        ch = chr(c)
        out[c] = 0 if ch.isspace() else 1 if ch.islower() else 2 if ch.isupper() else 4 if ch.isdigit() else 5 + c % 64 if c < 128 else 3
    return out


SHAPES = _shape_table()


def _repetition(words: list[str]) -> tuple[float, float]:
    follows = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    return len(set(words)) / max(1, len(words) ** 0.8), follows


def features(text: str | None) -> np.ndarray:
    """Counts of a text's terms over BUCKETS; an empty text has one term of its own."""
    out = np.zeros(BUCKETS, np.float32)
    if not text or not text.strip():
        out[0] = 1
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shape = np.where(points < 0x250, SHAPES[np.minimum(points, 0x24F)], 3)
    run = np.concatenate(([True], (shape[1:] != shape[:-1]) | (shape[1:] > 2)))
    shape = shape[run]  # runs of like letters count once
    n = max(1, len(shape) - 2)
    if len(shape) >= 3:
        code = (shape[:-2] * 71 + shape[1:-1]) * 71 + shape[2:]
        np.add.at(out, 64 + (code * 2654435761 >> 7) % (BUCKETS - 64), 1.0) if len(code) < 4096 else None
        if len(code) >= 4096:
            out[64:] += np.bincount((code * 2654435761 >> 7) % (BUCKETS - 64), minlength=BUCKETS - 64)
        out *= 200.0 / n
        out = np.log1p(out)
    words = text.split()
    variety, follows = _repetition(words)
    letters = int((shape == 1).sum() + (shape == 2).sum())
    upper = float((np.isin(SHAPES[np.minimum(points, 0x24F)], (2,))).mean())
    signs = float((SHAPES[np.minimum(points, 0x24F)] >= 5).mean())
    for at, value, scale in ((1, follows, 20), (9, 1 - min(1.0, variety), 8), (17, upper, 20), (25, signs, 30), (33, letters / max(1, len(points)), 5)):
        out[at + min(7, int(value * scale))] = 2.0
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # BUCKETS x DIMENSIONS
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        z = (counts * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of the similarity-weighted votes for label 1."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for k in range(0, len(texts), BLOCK):
            own = self.embed(np.stack([features(t) for t in texts[k : k + BLOCK]]))
            cosine = own @ self.vectors.T
            near = min(NEIGHBOURS, cosine.shape[1])
            least = -np.partition(-cosine, near - 1, axis=1)[:, near - 1 : near]
            # all labelled rows as near as the last neighbour vote, so that ties have no order
            row, at = np.nonzero(cosine >= least - TIE)
            weight = np.maximum(cosine[row, at], 0).astype(np.float64) ** 8 + 1e-9
            vote = np.bincount(row, weight * self.labels[at], len(own)) + 0.2 * self.prior
            out[k : k + BLOCK] = vote / (np.bincount(row, weight, len(own)) + 0.2)
        return np.clip(out, 0.0, 1.0)


Vector = tuple[bytes, bytes]


def sparse(text: str | None) -> Vector:
    """The features that are not 0: their places (two bytes each) and counts (four)."""
    counts = features(text)
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes(), counts[at].astype("<f4").tobytes()


def _dense(vectors: list[Vector]) -> np.ndarray:
    out = np.zeros((len(vectors), BUCKETS), np.float32)
    for row, (at, counts) in zip(out, vectors, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(counts, "<f4")
    return out


def fit(rows: list[tuple[Vector | str | None, int]], seed: int = 11) -> Model:
    """Fit the space and keep the labelled vectors; no rows give a model that scores 0.5.

    Rows are whole texts or their sparse features; only BLOCK of them are dense at a time.
    """
    if not rows:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    labels = np.array([float(y == 1) for _, y in rows])
    vectors = [x if isinstance(x, tuple) else sparse(x) for x, _ in rows]
    blocks = [vectors[k : k + BLOCK] for k in range(0, len(vectors), BLOCK)]
    held = sum((_dense(b) > 0).sum(axis=0) for b in blocks)
    idf = np.log((1 + len(rows)) / (1 + held)).astype(np.float32) + np.float32(0.3)
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(BUCKETS, min(DIMENSIONS + 8, len(rows)))).astype(np.float32)
    for _ in range(3):  # randomised subspace iteration
        product = np.zeros_like(q)
        for b in blocks:
            weighted = _dense(b) * idf
            product += weighted.T @ (weighted @ q)
        q, _r = np.linalg.qr(product)
    projected = np.concatenate([(_dense(b) * idf) @ q for b in blocks])
    _u, _s, vt = np.linalg.svd(projected, full_matrices=False)
    z = projected @ vt.T[:, :DIMENSIONS]
    return Model(idf, (q @ vt.T[:, :DIMENSIONS]).astype(np.float32), (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32), labels, float(labels.mean()))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[Vector, int]]:
    """(sparse features of the whole text, label) of up to about ``rows`` labelled rows, chosen by a hash of doc_id
    after counting the labels.

    The features are made on the executors; no text leaves them. A doc_id with several labels or texts counts with
    each, repeats once.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("long").alias("quality")).where("quality is not null").distinct()
    n = known.count()
    if not n:
        return []
    h = F.xxhash64(F.lit(31), F.col("doc_id"))
    part = known.where(F.shiftrightunsigned(h, 11) / float(1 << 53) < min(1.0, rows / n))
    found = docs.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("text", h.alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = zip(*[sparse(x.as_py()) for x in batch.column(0)], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["h", "doc_id", "quality", "at", "counts"])

    made = found.mapInArrow(run, "h long, doc_id long, quality long, at binary, counts binary").distinct().collect()
    made.sort(key=lambda r: (r["h"], r["doc_id"], bytes(r["at"]), bytes(r["counts"])))
    return [((bytes(r["at"]), bytes(r["counts"])), int(r["quality"])) for r in made]


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """The rows of docs with a column ``score`` (0 to 1, higher: label 1 likelier) from the whole text alone.

    Null and empty texts are scored as empty; repeated rows stay repeated; other columns are kept, and one
    that has the name of the score is replaced. Labelled rows as near as the last neighbour all vote. An
    empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() != score.lower()]
    at = names.index(text)
    shape = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, score])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, shape)
