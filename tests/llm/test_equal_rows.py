"""Many equal rows, and tables with columns named like every helper column of the operators."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwick.llm import jaccard, mixing, packing, substrings
from tests.helpers import saved
from tests.llm.helpers import made_documents

TEXT = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("parts", [1, 7])
def test_substrings_of_many_equal_rows(spark, parts):
    rows = spark.range(4000).selectExpr("9L as doc_id", f"'{TEXT}' as text")
    rows = rows.unionByName(spark.createDataFrame([(3, TEXT + " more"), (10, "x y " + TEXT)], "doc_id long, text string")).repartition(parts)
    out = substrings.remove_repeats(rows).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert {tuple(r) for r in out} == {(9, 60, 60, "", 4000), (3, 61, 0, TEXT + " more", 1), (10, 62, 60, "x y", 1)}


def test_lists_of_equal_rows_do_not_grow_with_them():
    import numpy as np

    one = [np.full(41, 9), np.full(41, 5), np.arange(41)]
    sizes = []
    for n in (1, 50):
        ids, keys, start = (np.tile(x, n) for x in one)
        i, k, gone = substrings._gone_rows(ids, keys, start)
        sizes.append((len(i), gone.to_pylist()))
    assert sizes[0] == sizes[1] == (1, [[0, 41]])


def helper_names():
    """Every name of a helper column, as the sources give it."""
    found = {"_mix_" + x for x in "key copies rows n nth row salt base".split()}
    for f in Path(mixing.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'(?:alias|withColumn|free\(docs, )\(?"(\w+)"', f.read_text()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars", "url", "html", "payload"})


def named(spark, rows):
    """Documents with a string column of each helper's name, holding that name and the row's number."""
    docs = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "rownum long, doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n + " "), F.col("rownum").cast("string")).alias(n) for n in helper_names()])


def test_stages_keep_columns_named_like_their_helpers(spark):
    rows = [r for r in made_documents(60, long=False)]
    rows += [rows[5]] * 20
    docs = named(spark, rows)
    docs = docs.unionByName(docs.filter("doc_id = 5").limit(1)).unionByName(docs.filter("doc_id = 5").limit(1)).repartition(3).cache()
    there = Counter(docs.collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(there)
    single = jaccard.one_of_each(docs)
    assert single.columns == docs.columns and not Counter(single.collect()) - there
    docs.unpersist()


def test_all_stages_of_the_pipeline_keep_clashing_columns(spark, tmp_path):
    docs = named(spark, made_documents(40, long=False))
    saved(spark, [(1, 1, 0)], tmp_path, "labels", "doc_id long, quality int, toxic int")
    there = {tuple(r)[5:]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert tuple(r)[5:] in there, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in there.values()}


def test_packing_deals_equal_rows_over_all_salts(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("7L as doc_id", f"'{TEXT}' as text").repartition(4)
    kept = []
    whole = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, name: kept.append(whole(df, name)) or kept[-1])
    out = packing.pack(docs, packing.tokenizer_path(), 256)
    assert out.selectExpr("count(*) = 20000 and count(distinct sequence_id, offset) = 20000 and max(offset + length) <= 256 as ok").head().ok
    counts = [r["count"] for r in kept[0].groupBy("salt").count().collect()]
    assert len(counts) == packing.SALTS and max(counts) < 2 * 20_000 / packing.SALTS
