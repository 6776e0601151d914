import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_51_short_words_are_a_repeated_passage(spark):
    rng = random.Random(6)
    passage = " ".join(rng.choice("abcdefghijkl") for _ in range(51))
    rows = [(1, f"Eins {passage} und"), (2, f"Zwei, {passage}. Drei"), (3, "nichts davon")]
    out = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(passage) == 101 and got[1] == rows[0][1] and got[3] == rows[2][1] and passage not in got[2]
