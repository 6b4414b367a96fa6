"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import bpe, decontaminate, quality, queries, simhash
from tests.llm.test_lines import _brute_lines

SMALL = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


EDGE = [(1, None, "s", "x"), (2, "", "s", "x"), (3, "one", "s", "x"), (3, "one", "s", "x"), (None, "two words", None, None), (5, "word " * 30000, "s", "x"), (6, "\n\n  \n", "s", "x")]


def test_bpe_round_trip():
    path = public_tokenizers.path(queries.VOCABULARY)
    ours, theirs = bpe.SpeculativeBpe(path), Tokenizer.from_file(path)
    texts = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()]
    texts += ["", "a<|endoftext|> b", "\x1c\x1d x\x85y  z \n\n  q", "it's I'll DON'T", "𝔘 ñ😀 " * 3, "a" * 300, "xyz" * 2000, "\t\x00\x01", "   ", "end  "]
    for text, (ids, decoded) in zip(texts, ours.encode_batch(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == theirs.decode(want, skip_special_tokens=False)


def test_the_token_query_is_the_librarys(spark):
    """Digests of every document's ids and decoded text, and columns of clashing names."""
    theirs = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, text in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op7_bpe(spark, SMALL).collect()} == want
    odd = spark.createDataFrame([(1, None, 3, "x"), (None, "one", 4, "y"), (None, "one", 4, "y")], "doc_id long, text string, ids int, decoded string")
    got = bpe.encode(odd, public_tokenizers.path(queries.VOCABULARY))
    assert got.columns == ["doc_id", "ids", "decoded"]
    one = theirs.encode("one", add_special_tokens=False).ids
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in got.collect()) == [(0, one, "one"), (0, one, "one"), (1, [], "")]


def test_words_between_tasks_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_BETWEEN", 50)
    own = bpe.SpeculativeBpe(public_tokenizers.path(queries.VOCABULARY))
    texts = [" ".join(f"word{k}{j}" for j in range(40)) for k in range(5)]
    first = [i.tolist() for i in own.ids_batch(texts)]
    own.forget()
    assert len(own.words) == len(own.marks) and [i.tolist() for i in own.ids_batch(texts)] == first


def _brute_similar(texts):
    """The first text of each one's group, by the Jaccard similarity of sets of five words."""
    own = []
    for t in texts:
        w = t.lower().split()
        own.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("cap", [8, 2048])
def test_similar_texts_are_those_of_the_shingle_sets(spark, cap):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "one two", "One  two", "x " * 20000]
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(5000, size=400)]
        texts += [" ".join(words), " ".join(words).upper()]
        for changed in (1, 3, 6, 30):  # similarities of about 0.98, 0.93, 0.86 and 0.5
            copy = list(words)
            for at in rng.choice(400, changed, replace=False):
                copy[at] = "other"
            texts.append(" ".join(copy))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one two"), (None, "one two"), (None, "no id")]
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), cap=cap).collect()
    assert len(got) == len(rows)
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None and r["component_id"] is not None) == [3]
    label = _brute_similar([t or "" for t in texts])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == dict(enumerate(label))
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edge_rows_and_empty_tables(spark):
    path = public_tokenizers.path(queries.VOCABULARY)
    for rows in (EDGE, []):
        docs = _docs(spark, rows)
        assert bpe.encode(docs, path).count() == len(rows)
        assert simhash.near_duplicates(docs).count() == len(rows)


def test_pipeline_matches_brute_force(spark):
    """The classifier's own scores, then plain Python for lines, fingerprints, benchmark items and tokens."""
    import corpus_pipeline

    docs = queries.table(spark, SMALL, "documents")
    labels = queries.table(spark, SMALL, "labels").where(queries.fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(quality.sample(docs, labels))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    accepted = [x for x, s in zip(rows, model.score([t for _, t in rows]), strict=True) if s >= quality.ACCEPT]
    texts = _brute_lines(accepted)
    ids = np.array(sorted(texts))
    label = _brute_similar([texts[i] for i in ids.tolist()])
    kept = [int(i) for k, i in enumerate(ids) if label[k] == k]
    grams = lambda t: [" ".join(t[k : k + 5]) for k in range(len(t) - 4)]
    words = lambda t: decontaminate.WORD.findall(t.lower())
    items = [grams(words(r["text"])) for r in queries.table(spark, SMALL, "benchmark").collect()]
    clean = [i for i in kept if not any(sum(g in own for g in item) >= 0.8 * len(item) for own in [set(grams(words(texts[i])))] for item in items)]
    theirs = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    want = {i: theirs.encode(texts[i], add_special_tokens=False).ids for i in clean}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert len(corpus_pipeline.STAGES) == 5 and got == want


def test_a_group_around_the_least_similarity_stays_whole(spark):
    """Every candidate pair of 0.8 or more, whatever its estimate, links its texts."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(5000, size=400)]
    texts = []
    for k in range(300):  # similarities of pairs of about 0.75 to 0.85
        copy = list(words)
        for at in rng.choice(400, int(rng.integers(4, 7)), replace=False):
            copy[at] = f"other{k}"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    label = _brute_similar(texts)
    assert len({x for x in label if label.count(x) > 1}) == 1
    assert [got[k] for k in range(len(texts))] == label


def test_repeats_inside_a_line_do_not_hide_a_copy(spark):
    rng = np.random.default_rng(9)
    words = [[f"w{x}" for x in rng.integers(5000, size=300)] for _ in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:100] + w[100:110] * 200 + w[110:]) for w in words]
    label = _brute_similar(texts)
    assert label == [0, 1, 2, 3, 4, 5] * 2
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == label
