"""The stages in a row, each against its operator, and on an empty table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from redsieve.llm import mixing, neardup, outliers, qda
from redsieve.llm.common import saved
from tests.llm.test_documents import assert_packed, plain_components, rows_of


def test_stages(spark, sf_dir, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "packing"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf_dir), name)
        if name == "quality_rules":
            assert ids(out) == ids(outliers.outlier_verdicts(docs).where("kept")) and 0 < out.count() < docs.count()
        elif name == "quality_classifier":
            assert ids(out) == ids(qda.quality_scores(docs, labels).where("predicted = 1"))
        elif name == "near_dedup":
            assert ids(out) == Counter(i for i, (_, _, kept) in plain_components(rows_of(docs), 5).items() if kept)
            assert ids(out) == ids(neardup.near_duplicates(docs).where("kept"))
        elif name == "mixing":
            assert ids(out) == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
        else:
            assert_packed(out.collect(), docs)
        if name != "packing":
            assert out.schema == documents.schema
        docs = out
    # run() gives what the stages give in a row
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(piece, docs.collect()))


def test_stages_on_odd_rows(spark, sf_dir, odd):
    """Each stage in a row, and each by itself, on null, repeated and odd rows with other columns."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, odd, sf_dir)
        docs = saved(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert alone.columns == odd.columns and docs.columns == odd.columns
            assert alone.count() <= (2 if name == "mixing" else 1) * odd.count()
        else:
            assert alone.count() >= odd.count()
    rows = Counter((r.doc_id, r.text) for r in neardup.without_near_duplicates(odd).collect())
    assert max(n for (_, text), n in rows.items() if (text or "").strip()) == 1  # repeated rows are one


def test_run_on_nothing(spark, sf_dir, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0
