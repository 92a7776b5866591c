import corpus_pipeline
from helpers import documents
from pyspark.sql import functions as F
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from tablescope.llm import quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before it kept, next to a plain computation."""
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in raw.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_classifier"](spark, raw, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(quality.training_rows(raw, labels, "doc_id", "text", "quality"), "text", "label")
    scores = dict(zip(texts, model.scores(quality.matrix(texts.values()))))
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept == {i: t for i, t in texts.items() if scores[i] >= corpus_pipeline.LEAST_SCORE}
    assert good.columns == raw.columns

    single = stages["near_duplicates"](spark, good, FOLDER)
    component = plain_components({i: plain_fingerprint(t) for i, t in kept.items()})
    stays = {r.doc_id for r in single.collect()}
    assert stays == {i for i in kept if component[i] == i} and len(stays) < len(kept)
    assert single.columns == raw.columns

    masked = stages["private_data"](spark, single, FOLDER)
    rows = {r.doc_id: r for r in masked.collect()}
    assert set(rows) == stays and masked.columns == raw.columns
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert not any("@mail" in r.text for r in rows.values())
    clean = [i for i in stays if not any(c.isdigit() for c in kept[i])]
    assert clean and all(rows[i].text == kept[i] for i in clean)

    pieces = stages["packing"](spark, masked, FOLDER)
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows.items()}


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n < 2048").count() <= 1


def test_stages_take_odd_rows_and_extra_columns(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() >= 0
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0
