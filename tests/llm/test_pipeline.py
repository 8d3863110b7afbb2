"""Every stage of the corpus pipeline against a brute-force version of it."""

from __future__ import annotations

import random

import corpus_pipeline
from aerolake.llm import graph, pii, quality
from pyspark.sql import functions as F

from . import support
from .test_overlap import kept_rows


def _texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def _check(spark, docs, sf_dir):
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    judged = quality.judge(docs).where("kept").select("doc_id", F.col("clean_text").alias("text"))
    cleaned = stages["quality rules"](spark, docs, sf_dir)
    assert cleaned.columns == names and _texts(cleaned) == _texts(judged)

    single = stages["exact dedup"](spark, docs, sf_dir)
    keep = {}
    for doc_id, text in support.pairs(docs):
        keep[text] = max((d for d in (keep.get(text), doc_id) if d is not None), default=None)
    assert single.columns == names
    assert sorted(((i, t or "") for i, t in _texts(single)), key=str) == sorted(((d, t) for t, d in keep.items()), key=str)

    near = stages["near dedup"](spark, single, sf_dir)
    assert near.columns == names
    if "__id" in names:
        assert {r[0] for df in (single, near) for r in df.select("__id").collect()} == {1}
    assert sorted(support.pairs(near), key=str) == sorted(kept_rows(support.pairs(single)), key=str)

    plain = stages["personal data"](spark, docs, sf_dir)
    expected = [(r.doc_id, r.text if r.text is None else pii.redacted(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert plain.columns == names and _texts(plain) == sorted(expected, key=str)


def test_stages_on_the_tables(spark, sf_dir):
    _check(spark, support.documents(spark, sf_dir), sf_dir)


def test_stages_on_awkward_rows(spark, sf_dir):
    _check(spark, support.table(spark, support.awkward()), sf_dir)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0
    assert found.select("doc_id").distinct().count() <= support.documents(spark, sf_dir).count()


def test_empty(spark, sf_dir):
    docs = support.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir) if stage is not corpus_pipeline.pack else docs
        assert docs.count() == 0


#: Names that the operators of the stages give out or use inside, each as a column of another type.
OWN = (
    "kept n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lines_lost chars_lost clean_text __text __words __lines __plain __windows __twice __starts "
    "__measured __judged __lost __worded row part line rule id sha node key keep_id keep_node group_size text_sha256 component_id root fp fp2 prints shingles spans a b m"
).split()


def test_no_extra_column_is_lost_or_rewritten(spark):
    texts = ["\n".join(" ".join(f"w{i}x{k}y{j}" for j in range(7)) + "." for k in range(10)) for i in range(6)]
    rows = [(i, t, "en", "web", len(t), *[{"at": n * 100 + i} for n in range(len(OWN))]) for i, t in enumerate(texts)]
    columns = ", ".join(f"`{name}` struct<at: int>" for name in OWN)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        got = sorted(out.collect(), key=lambda r: r[0])
        assert [r.doc_id for r in got] == list(range(6)), name
        assert [[v["at"] for v in r[5:]] for r in got] == [[n * 100 + i for n in range(len(OWN))] for i in range(6)], name


def test_forest_keeps_the_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] * 3
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    contracted = graph.forest(table)
    assert sorted(map(tuple, graph.components(contracted).collect())) == sorted(map(tuple, graph.components(table).collect()))
    assert contracted.count() <= 3 * 299
