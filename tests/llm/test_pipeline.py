"""The pipeline's stages act as they say, and the whole tolerates odd tables."""

import re

import corpus_pipeline


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf).collect(), docs.schema)
        assert after.schema.names == docs.schema.names and 0 < after.count() <= before.count(), name
        before = after
    texts = [r.text for r in before.collect()]
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", t) for t in texts)
    ids = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == ids


def test_null_ids_and_repeated_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, "some words that stand here alone", "en", "a", 32), (1, "some words that stand here alone", "en", "a", 32),
            (None, "some words that stand here alone", None, None, None), (2, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
    # A verbatim copy without an id leaves: being a copy does not depend on having an id (this line once expected it to stay).
    assert sorted(r.doc_id or 0 for r in kept) == [1, 2]
    assert corpus_pipeline.pii_stage(spark, docs, sf).count() == 4
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf).count() == 0


def test_rows_that_share_an_id(spark, sf):
    """Different texts under one id both stay, and copies of either are found."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    a, b, c = (" ".join(f"{letter}{k}" for k in range(60)) for letter in "abc")
    rows = [(5, a), (5, b), (5, a), (6, a + " end"), (7, b + " end"), (8, c), (9, c + " end"), (9, "alone " + a[::-1]), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], schema)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(5, a), (5, b), (8, c), (9, "alone " + a[::-1]), (5, "")])


def test_null_ids_are_compared(spark, sf):
    """Of copies without any id one stays, near ones too; wordless rows without an id all stay."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    a, b = (" ".join(f"{letter}{k}" for k in range(60)) for letter in "ab")
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (7, b + " end"), (None, None), (None, ""), (None, "c d")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], schema)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
    stay = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept)
    assert stay == [(0, ""), (0, ""), (0, "a0"), (0, "c "), (7, "b0")]


def test_columns_with_clashing_names(spark, sf):
    """Columns named like those inside the near-copy stage come back as they were."""
    text = " ".join(f"a{k}" for k in range(60))
    names = ["_id", "_digest", "digest", "nameless", "row_id", "row", "node", "component", "set_a", "n_chars"]
    docs = spark.createDataFrame([(i, text, *[f"{c}{i}" for c in names]) for i in (1, 2)],
                                 "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
    assert [tuple(r) for r in kept] == [(1, text, *[f"{c}1" for c in names])]
