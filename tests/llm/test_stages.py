"""The pipeline's stages on odd rows, clashing columns and empty tables."""

import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars int, score string, gone int, n_lines int"


@pytest.mark.parametrize("empty", [True, False])
def test_stages_keep_columns_of_any_name_and_odd_rows(spark, empty):
    clean = "The cat sat on the mat and looked at the old man with the hat. Then it went home."
    rows = [] if empty else [(1, clean, "en", "s", 81, "x", 7, 3), (1, clean, "en", "s", 81, "x", 7, 3), (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "y", 8, 4), (None, clean + " More words.", None, "s", 5, "z", 9, 5), (4, "word " * 30_000, "en", "s", 150_000, "w", 1, 1)]
    docs = spark.createDataFrame(rows, SHAPE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) <= len(rows)
        known = {(r[0], r[5], r[6], r[7]) for r in rows}
        assert all((r["doc_id"], r["score"], r["gone"], r["n_lines"]) in known for r in got), name
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert done.columns == ["doc_id", "n_tokens", "ids"] and done.count() == len(rows)


def test_one_document_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, "quite another text of ten words that has no partner"), (None, " ".join(words)), (7, None), (8, "")]
    out = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 7, 9]
