"""Extra columns of any name come back as they were, from operators that return whole rows and from the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import hyperminhash, mixing, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["__size", "__u", "__wish", "__text", "__plan_rate", "__id", "row", "whole_row", "chance", "kid", "id", "worded", "mix_copies", "score", "predicted", "__k", "a.b", "c`d", "col"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null, empty, blank, repeated and long texts, null ids and sources, and columns that clash."""
    texts = ["", None, " \t", "one two three four five six seven", "One two three four five six seven", "x" * 50_000, "word " * 5000, "you are such an idiot and a moron"]
    rows = [(None if i == 9 else i % 24, texts[i % len(texts)], "en", None if i % 4 == 0 else f"s{i % 3}", 7, *[f"{n}={i}" for n in ODD]) for i in range(32)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in ODD))


def same_rows(out, docs):
    own = set(map(tuple, docs.collect()))
    got = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns
    assert all(r in own for r in got)
    return got


def test_mixture_keeps_the_columns(spark, odd):
    got = same_rows(mixing.mixture(odd), odd)
    taken = mixing.mix(odd).agg(F.sum("mix_copies")).first()[0]
    assert len(got) == taken > 0
    kept = mixing.mix(odd)
    assert kept.columns == [c for c in odd.columns if c != "mix_copies"] + list(mixing.OUT)
    assert {r["__size"] for r in kept.collect()} == {f"__size={i}" for i in range(32)}


def test_keep_one_keeps_the_columns(spark, odd):
    got = same_rows(hyperminhash.keep_one(odd), odd)
    texts = [r[1] for r in got if r[1] and r[1].strip()]
    assert sorted(map(len, texts)) == sorted(map(len, ["one two three four five six seven", "x" * 50_000, "word " * 5000, "you are such an idiot and a moron"]))
    assert sum(not r[1] or not r[1].strip() for r in got) == 12


@pytest.mark.parametrize("empty_labels", [True, False])
def test_toxicity_keeps_the_columns(spark, odd, empty_labels):
    labels = spark.createDataFrame([] if empty_labels else [(None, 1), (3, None), (3, 0), (7, 1), (7, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scored = toxicity.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    got = same_rows(toxicity.reject(odd, model), odd)
    assert len(got) == scored.filter("predicted = 0").count()
    assert not any(r[1] and "idiot" in r[1] for r in got)


def test_stages_take_odd_and_empty_tables(spark, odd):
    for docs in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            same_rows(out, docs)
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count(), name
