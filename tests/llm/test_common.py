import os

import pytest

from lodestar.llm import queries
from lodestar.llm.common import components, release, scope, shared_dir, written

SF = "/root/testdata/sf0.001"


def held(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op1_language_id", "op2_suffix_dedup", "op3_best_fit_packing", "op4_ivfpq_search", "op5_minhash_near_dedup", "op7_embedding_near_dedup", "op8_line_spread", "pipeline"])
def test_only_what_the_result_reads_stays(spark, name):
    before = held(spark)
    result = queries.QUERIES[name](spark, SF)
    left = held(spark) - before
    read = {f for f in left if any(f in path for path in result.inputFiles())}
    assert left == read
    assert result.count() > 0


def test_scopes(spark):
    before = held(spark)
    with scope() as outer:
        with scope() as inner:
            a, b = written(spark.range(3), "a"), written(spark.range(4), "b")
            inner.keep(a)
        assert len(held(spark) - before) == 1
        outer.keep_rest()
    assert a.count() == 3
    release(outer, a)
    assert a.count() == 3
    release(outer, spark.range(1))
    assert held(spark) == before and b is not None
    with pytest.raises(RuntimeError), scope() as failed:
        failed.keep(written(spark.range(3), "c"))
        raise RuntimeError
    assert held(spark) == before


def test_components_of_a_hub_and_a_chain(spark):
    star = [(500, i) for i in range(400)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame(star + chain + [(7, 7), (5, 500)], "a long, b long").repartition(3)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys([*range(400), 500], 0), **dict.fromkeys(range(1000, 1041), 1000)}
    assert components(edges.limit(0)).count() == 0
