import pytest

from twinfold.operators import ranks


@pytest.mark.parametrize("most", [None, 50, 1])
def test_positions_of_groups_of_any_size(spark, most):
    df = spark.range(700).selectExpr("IF(id % 7 < 5, 'large', concat('g', id % 90)) AS k", "(id * 37) % 700 AS o", "id AS x").repartition(6)
    want, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        seen[r.k] = want[r.x] = seen.get(r.k, 0) + 1
        want[r.x] = seen[r.k]
    out = ranks.ranked(df, ["k"], "o", "n", most)
    assert out.columns == ["k", "o", "x", "n"] and dict(out.dtypes)["n"] == "int"
    assert {r.x: r.n for r in out.collect()} == want


def test_empty(spark):
    assert ranks.ranked(spark.range(0).selectExpr("id AS k", "id AS o"), ["k"], "o", "n").count() == 0
