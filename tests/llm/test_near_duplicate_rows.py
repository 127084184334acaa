"""The pipeline's near-duplicate stage over rows whose doc_ids are null or repeated."""

import corpus_pipeline
import pytest


@pytest.mark.parametrize("written", [True, False])
def test_one_row_of_each_group(spark, tmp_path, written):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    rows = [
        (None, text["a"]),  # unique, without an id
        (None, text["b"]), (None, text["b"]),  # a group without any id
        (1, text["c"]), (1, text["c"]), (1, text["c"]),  # repeated rows
        (2, text["d"]), (2, text["e"]),  # one id, two texts
        (4, text["f"]), (3, text["f"]), (None, text["f"]),
        (2, text["g"]), (5, text["d"]), (6, text["e"]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if written:
        docs.write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    out = corpus_pipeline.one_of_each(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == ["doc_id", "text"]
    want = [(None, "a"), (None, "b"), (1, "c"), (2, "d"), (2, "e"), (3, "f"), (2, "g")]
    assert sorted(got, key=str) == sorted([(i, text[k]) for i, k in want], key=str)
