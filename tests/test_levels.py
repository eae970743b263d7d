import pytest

from ledgerline.operators import graph as G


def test_deep_chains_are_not_cycles(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    with pytest.raises(RuntimeError):
        G.execution_levels(chain, rounds=2)
    got = {tuple(r) for r in G.execution_levels(chain, rounds=4).collect()}
    assert got == {("d", 0, False), ("c", 1, False), ("b", 2, False), ("a", 3, False)}
