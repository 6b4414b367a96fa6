"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify.

A proposal is the true encoding of a word exactly if every adjacent pair of its tokens is what
merging makes of the pair's own bytes. Pairs are tested as arrays against the pairs known so far;
each unknown pair is merged once. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORDS_KEPT = 700_000
LONGEST_KEPT = 48
#: Words that are kept from one task to the next.
WORDS_BETWEEN = 100_000
ALONE = 0xFFFFFFFF
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder of one vocabulary file (a byte-level BPE in tokenizers' JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(t): i for t, i in vocab.items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.longest: dict[bytes, int] = {}
        for t in self.ids:
            self.longest[t[:4]] = max(self.longest.get(t[:4], 0), len(t))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.shown = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        rules = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.ranks.items())
        self.rule_keys, self.rule_ranks = np.array([k for k, _ in rules]), np.array([r for _, r in rules])
        self.made = np.zeros(len(spec["model"]["merges"]), np.int64)
        for rank, new in self.ranks.values():
            self.made[rank] = new
        self.marks = {t: np.array([i], np.int32).tobytes() for t, i in self.special.items()}
        self.words: dict[str, bytes] = dict(self.marks)  # a word's ids, four bytes each
        self.older: dict[str, bytes] = {}  # what the table held before it last filled up
        self.pair_keys, self.pair_good = np.empty(0, np.int64), np.empty(0, bool)
        self.failed = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one long word with a heap, in time n log n: lowest rank first, leftmost among equals."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := self.ranks.get((new, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, new, ids[after[i]], r[1]))
            if (p := before[i]) >= 0 and (r := self.ranks.get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, ids[p], new, r[1]))
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 4], 3))
            while (found := ids.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def _good(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair (first * 2^32 + second) as it is; second is ALONE for a token by itself."""
        unique, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, unique)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == unique[known]
        good = np.zeros(len(unique), bool)
        good[known] = self.pair_good[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            pairs = [[k >> 32] if k & ALONE == ALONE else [k >> 32, k & ALONE] for k in unique[new].tolist()]
            merged = self.merge_many([b"".join([self.bytes[x] for x in pair]) for pair in pairs])
            good[new] = [m == pair for m, pair in zip(merged, pairs, strict=True)]
            self.pair_keys = np.insert(self.pair_keys, at[new], unique[new])
            self.pair_good = np.insert(self.pair_good, at[new], good[new])
        return good[back]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words side by side, a matrix row for each word of like length."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words])
        for low, high in ((1, 8), (9, 14), (15, 24), (25, 40)):
            own = np.flatnonzero((sizes >= low) & (sizes <= high))
            for k in range(0, len(own), 20_000):
                self._merge_rows(words, own[k : k + 20_000], high, out)
        for k in np.flatnonzero(sizes > 40).tolist():
            out[k] = self.merge(words[k])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into the sorted merge rules times their rank: NEVER where no rule joins a and b."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.rule_keys, keys), len(self.rule_keys) - 1)
        return np.where((self.rule_keys[at] == keys) & (a >= 0) & (b >= 0), self.rule_ranks[at], NEVER)

    def _merge_rows(self, words: list[bytes], own: np.ndarray, width: int, out: list[list[int]]) -> None:
        ids = np.full((len(own), width + 1), -1, np.int64)
        for r, k in enumerate(own.tolist()):
            ids[r, : len(words[k])] = np.frombuffer(words[k], np.uint8)
        ids = np.where(ids >= 0, self.byte_ids[ids], -1)
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width + 1)
        while len(own):
            j = ranks.argmin(axis=1)
            row = np.arange(len(own))
            best = ranks[row, j]
            done = best == NEVER
            if done.any():
                for k, x in zip(own[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = x[: x.index(-1)]
                own, ids, ranks, j, best = own[~done], ids[~done], ranks[~done], j[~done], best[~done]
                row = np.arange(len(own))
                if not len(own):
                    break
            after = columns[None, :-1] > j[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            ids[row, j] = self.made[best]
            ranks[row, j] = self._rank(ids[row, j], ids[row, j + 1])
            left = j > 0
            ranks[row[left], j[left] - 1] = self._rank(ids[row[left], j[left] - 1], ids[row[left], j[left]])

    def learn(self, words: list[str]) -> list[bytes]:
        """Encode new words together: propose all, test all adjacent pairs at once, merge what fails."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        counts = np.array([len(p) for p in proposed])
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(counts.sum()))
        last = np.cumsum(counts) - 1
        second = np.append(flat[1:], ALONE)
        second[last] = ALONE
        tested = np.ones(len(flat), bool)
        tested[last[counts > 1]] = False  # the last token of several is tested with the one before it
        fails = np.zeros(len(flat), bool)
        fails[tested] = ~self._good(flat[tested] << 32 | second[tested])
        bad = np.flatnonzero(np.add.reduceat(fails, last - counts + 1))
        self.failed += len(bad)
        for k, ids in zip(bad, self.merge_many([raw[k] for k in bad]), strict=True):
            proposed[k] = ids
        return [np.array(ids, np.int32).tobytes() for ids in proposed]

    def forget(self) -> None:
        """Give back the words of a task: the worker is used again, by other stages as well, which need its memory."""
        if len(self.words) + len(self.older) > WORDS_BETWEEN:
            self.words, self.older = dict(self.marks), {}

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """(ids, decoded text) of each text; the decoded text is made from the ids."""
        return [(ids, self.decode(ids)) for ids in self.ids_batch(texts)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def ids_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split: list[list[str]] = []
        for text in texts:
            pieces = self.cut.split(text) if self.cut else [text]
            split.append([w for p in pieces for w in ([p] if p in self.special else self.split.findall(p))])
        if len(self.words) > WORDS_KEPT:
            self.older, self.words = self.words, dict(self.marks)
        known = self.words
        fresh = set(chain.from_iterable(split)).difference(known)
        for w in fresh.intersection(self.older):
            known[w] = self.older[w]
        new = sorted(fresh.difference(known))
        known.update(zip(new, self.learn(new), strict=True))
        out = []
        for words in split:
            out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32))
        for w in new:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out


_loaded: dict[str, SpeculativeBpe] = {}


def tokenizer(path: str) -> SpeculativeBpe:
    """The tokenizer of this worker process; its word and pair tables outlive a batch."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text; a null text counts as empty.

    Strings of special tokens inside a text become those tokens. Row order and repeats are kept as
    they are, a null doc_id stays null, other columns (whatever their names) are not read; an empty
    table gives an empty result. Without ``decode`` the ids are not decoded and that column is not there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                done = bpe.ids_batch([x or "" for x in part.column(1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in done]))).astype(np.int32)
                columns = [part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(done)))]
                if decode:
                    columns.append(pa.array([bpe.decode(ids) for ids in done], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        bpe.forget()

    shape = "doc_id long, ids array<int>" + (", decoded string" if decode else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, shape)
