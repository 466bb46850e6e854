"""The pipeline on planted cases, stage by stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm.common import vocabulary_path

#: Columns of which some are named like those of the stages.
EXTRA = ["extra", "kept", "reason", "component_id", "th", "tid", "ord", "item_id", "start", "length", "a.b", "__row", "__h", "__id", "__tid"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _planted():
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("aeioubcdst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    clean = [say(150) for _ in range(6)]
    near = clean[1].split()
    near[70] = "changed"
    passage, item = say(110), say(30)
    texts = [*clean, clean[0], " ".join(near), say(20) + " " + passage + " " + say(60), say(25) + " " + passage + " " + say(60), say(60) + " " + item + " " + say(60), "too short", None, say(6) * 12]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3]], passage, item  # one row twice


def test_stages(spark, tmp_path):
    rows, passage, item = _planted()
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in EXTRA}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert k == 0 or k == 4 or docs.count() == len(seen[name])  # repeated rows are one document
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
    assert set(seen["quality rules"]) == set(range(11))
    assert set(seen["near-duplicates"]) == {0, 1, 2, 3, 4, 5, 8, 9, 10}
    texts = {i: r.text for i, r in seen["repeated passages"].items()}
    assert passage in texts[8] and passage not in texts[9] and all(texts[i] == rows[i][1] for i in (0, 1, 2, 3, 4, 5, 10))
    assert set(seen["benchmark leaks"]) == {0, 1, 2, 3, 4, 5, 8, 9}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["benchmark leaks"].values())
    assert docs.agg(F.sum("length")).first()[0] == want
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == want


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
