"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of the corpus.

The index holds, for each block of ITEMS_IN_BLOCK items, the greatest impact of each term: block-max
WAND. A passage's sum of block maxima bounds its score for every item of the block, and blocks below
their least threshold are skipped; all sums of a batch are made as arrays. What is left is scored
exactly, and every (passage, item) at or above the item's threshold is verified: shared five-word
grams must cover the question and the answer of the item.

An item's threshold is the least score that verification can ask for: of any run of its question that is
sure to lie in one passage, what is left without the heaviest words, as many as the share of missing
grams allows. The answer may lie anywhere in the text. Frequencies, mean length and so thresholds and
scores are those of the whole benchmark, however many indexes it is searched in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint

GRAM, OVERLAP, ANSWER_OVERLAP = 5, 0.8, 0.5
WINDOW, STRIDE = 64, 32
K1, B = 1.2, 0.75
ITEMS_IN_BLOCK = 16
#: Items and characters of one index, which bound what is broadcast (block maxima: terms x items / 16);
#: a larger benchmark is searched index by index.
ITEMS_IN_INDEX, CHARS_IN_INDEX = 2000, 1 << 20
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(GRAM)], np.uint64)


@dataclass
class Stats:
    """Of a whole benchmark: items and words, and in how many items each word is."""

    items: int
    words: int
    df: Mapping[str, int]


def _least(asked: np.ndarray, weight: dict[int, float]) -> float:
    """Least score of a passage with the run of a question that lies in it for sure, if OVERLAP of its grams are there."""
    missing = int((1 - OVERLAP) * max(1, len(asked) - GRAM + 1) + 1e-9)
    sure = WINDOW - STRIDE + 1
    runs = []
    for s in range(max(1, len(asked) - sure + 1)):
        own = sorted(weight[w] for w in set(asked[s : s + sure].tolist()))
        runs.append(math.fsum(own[: max(1, len(own) - missing)]))
    return min(runs)


@dataclass
class Index:
    """terms: word to number; block_max: terms (and one row of zeros) x blocks."""

    items: list[int]
    terms: dict[str, int]
    block_max: np.ndarray
    least: np.ndarray  # of each block
    threshold: np.ndarray  # of each item
    tokens: list[np.ndarray] = field(default_factory=list)
    question: list[int] = field(default_factory=list)  # tokens before the answer
    by_block: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # a block's terms in order, and their impact (and one row of zeros) x its items
    weights: list[dict[int, float]] = field(default_factory=list)  # of each item's terms

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], stats: Stats | None = None) -> Index:
        """``stats``: of the whole benchmark; None: the rows are all of it."""
        rows = [(i, words, t) for i, t in rows if t and (words := WORD.findall(t.lower()))]
        stats = stats or Stats(len(rows), sum(len(words) for _, words, _ in rows), Counter(w for _, words, _ in rows for w in set(words)))
        terms: dict[str, int] = {}
        for _, words, _ in rows:
            for w in words:
                terms.setdefault(w, len(terms))
        n = len(rows)
        tokens = [np.array([terms[w] for w in words]) for _, words, _ in rows]
        mean = stats.words / max(1, stats.items)
        weights: list[dict[int, float]] = []
        for _, words, _ in rows:
            counts = Counter(words)
            tf = np.array(list(counts.values()), np.float64)
            of = np.array([stats.df[w] for w in counts], np.float64)
            idf = np.log(1 + (stats.items - of + 0.5) / (of + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            weights.append(dict(zip((terms[w] for w in counts), impact.tolist(), strict=True)))
        blocks = range(0, n, ITEMS_IN_BLOCK)
        block_max = np.zeros((len(terms) + 1, len(blocks)), np.float32)
        by_block = []
        for b, k in enumerate(blocks):
            own = weights[k : k + ITEMS_IN_BLOCK]
            there = np.unique(np.concatenate([np.fromiter(w, np.int64, len(w)) for w in own]))
            table = np.zeros((len(there) + 1, len(own)), np.float32)
            for i, w in enumerate(own):
                table[np.searchsorted(there, np.fromiter(w, np.int64, len(w))), i] = np.fromiter(w.values(), np.float64, len(w))
            block_max[there, b] = table[:-1].max(axis=1)
            by_block.append((there, table))
        question = []
        for (_, words, text), t in zip(rows, tokens, strict=True):
            sentences = [s for s in SENTENCE.split(text.strip()) if WORD.search(s)]
            question.append(len(t) - len(WORD.findall(sentences[-1].lower())) if len(sentences) > 1 else 0)
        threshold = np.array([_least(t[: q if q >= min(GRAM, len(t)) else len(t)], w) for t, q, w in zip(tokens, question, weights, strict=True)])
        least = np.array([threshold[k : k + ITEMS_IN_BLOCK].min() for k in blocks], np.float32)
        return cls([i for i, _, _ in rows], terms, block_max, least, threshold, tokens, question, by_block, weights)

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(number of the text, item, best score, question overlap, answer overlap) of the items that whole texts hold."""
        get, none = self.terms.get, len(self.terms)
        ids = [np.array([get(w, none) for w in WORD.findall(t.lower())], np.int64) if t and self.items else np.empty(0, np.int64) for t in texts]
        rows = [self._passages(x) for x in ids]
        owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        passages = np.concatenate(rows) if rows else np.empty((0, WINDOW), np.int64)
        asked: dict[tuple[int, int], list[int]] = {}  # the passages of a text that an item may have
        for s in range(0, len(passages), 4096):
            own, of = passages[s : s + 4096], owner[s : s + 4096]
            own = own[:, : max(1, int((own != none).sum(axis=1).max()))]
            bound = np.zeros((len(own), self.block_max.shape[1]), np.float32)
            for k in range(own.shape[1]):
                bound += self.block_max[own[:, k]]
            left = bound >= self.least * 0.999
            for b in np.flatnonzero(left.any(axis=0)).tolist():
                first = b * ITEMS_IN_BLOCK
                kept = np.flatnonzero(left[:, b])
                terms, impact = self.by_block[b]
                at = np.minimum(np.searchsorted(terms, own[kept]), len(terms) - 1)
                at = np.where(terms[at] == own[kept], at, len(terms))
                score = np.zeros((len(kept), impact.shape[1]), np.float32)
                for k in range(own.shape[1]):
                    score += impact[at[:, k]]
                for r, k in zip(*np.nonzero(score >= self.threshold[first : first + ITEMS_IN_BLOCK] * 0.999), strict=True):
                    asked.setdefault((int(of[kept[r]]), int(k) + first), []).append(s + int(kept[r]))
        out = []
        for (d, k), at in sorted(asked.items()):
            share = self.overlap(ids[d], k)
            if share[0] >= OVERLAP and share[1] >= ANSWER_OVERLAP:
                # exact sums: they depend on neither the order nor the numbers of terms
                score = max(math.fsum(self.weights[k].get(w, 0.0) for w in passages[r].tolist()) for r in at)
                if score >= self.threshold[k]:
                    out.append((d, self.items[k], score, *share))
        return out

    def _passages(self, ids: np.ndarray) -> np.ndarray:
        """The distinct known terms of each passage, a row each, filled up with the row of zeros."""
        none = len(self.terms)
        if not (ids != none).any():
            return np.empty((0, WINDOW), np.int64)
        ids = np.concatenate((ids, np.full(max(0, WINDOW - len(ids)) + (-(len(ids) - WINDOW)) % STRIDE, none)))
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE], axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
        rows.sort(axis=1)
        return rows

    def overlap(self, ids: np.ndarray, item: int) -> tuple[float, float]:
        """Share of the question's and of the answer's words that lie in grams which the text has too, gram by gram for the question."""
        own = self.tokens[item]
        g = min(GRAM, len(own))
        there = np.isin(_grams(own, g), _grams(ids, g))
        covered = np.zeros(len(own), bool)
        for k in range(g):
            covered[k : k + len(there)] |= there
        q = self.question[item]
        asked = there[: max(1, q - g + 1)] if q >= g else there
        return float(asked.mean()), float(covered[q:].mean())


def _grams(ids: np.ndarray, g: int) -> np.ndarray:
    if len(ids) < g:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - g + 1, np.uint64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    for k in range(g):
        out = (out ^ (out >> np.uint64(31))) * MIX[0] + wide[k : k + len(out)] * MIX[k]
    return out


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and test item that it holds.

    Whole texts are searched, as overlapping passages of WINDOW words. Items without a word match
    nothing; an item of under five words is one gram. Null or empty texts hold nothing. Repeated
    documents give repeated rows; items that share an id give a row each; null ids stay null. Other
    columns, whatever their names, are not read. Either table may be empty.
    """
    shape = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], shape)
    for own, shared in enumerate(_indexes(benchmark, item_id, item_text)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[d], *hit) for d, *hit in shared.value.hits(batch.column(1).to_pylist())]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = base.mapInArrow(run, shape)
        out = one if own == 0 else out.union(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no test item, with all their columns: what find() tells, row by row as texts
    are read, without a join."""
    at = docs.columns.index(text)
    out = docs
    for shared in _indexes(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {d for d, *_ in shared.value.hits(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([d not in held for d in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def _indexes(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Broadcast[Index]]:
    """The benchmark as broadcast indexes of ITEMS_IN_INDEX items and CHARS_IN_INDEX characters or so."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.count("t").alias("items"), F.sum(F.length("t")).alias("chars")).first()
    parts = max(1, -(-size["items"] // ITEMS_IN_INDEX), -(-(size["chars"] or 0) // CHARS_IN_INDEX))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int")
    words = checkpoint(items.select(part.alias("part"), "t").mapInArrow(_words, "part int, word string, n long")) if parts > 1 else None
    for own in range(parts):
        rows = sorted(((r["i"], r["t"]) for r in items.where(part == own).collect()), key=lambda r: (r[0] is not None, r))
        yield spark.sparkContext.broadcast(Index.build(rows, _stats(words, own) if parts > 1 else None))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, word, times) of each item; the word is null for the item itself."""
    for batch in batches:
        rows: list[tuple] = []
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = Counter(WORD.findall(text.lower()))
            if counts:
                rows += [(part, None, sum(counts.values())), *((part, w, n) for w, n in counts.items())]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["part", "word", "n"])


def _stats(words: DataFrame, part: int) -> Stats:
    """The whole benchmark's statistics, with the frequencies of one part's words: as many as an index can have."""
    whole = words.where("word is null").agg(F.count("n").alias("items"), F.sum("n").alias("words")).first()
    own = words.where((F.col("part") == part) & F.col("word").isNotNull()).select("word").distinct()
    df = words.join(own, "word").groupBy("word").agg(F.count("n").alias("df"))
    return Stats(whole["items"], whole["words"] or 0, {r["word"]: r["df"] for r in df.collect()})
