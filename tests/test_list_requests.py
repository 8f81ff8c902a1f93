"""Every customer makes a list request, whatever its id."""

from tessera import queries


def test_lmpop_of_all_customers(spark, tmp_path):
    customers = [0, 7, 200, 201, 350, 1000, 90_000]
    turns = [(c, t, f"{c}/{t}") for c in (0, 14, 201, 700, 1050, 2000, 3000, 180_000) for t in (2, 5, 9)]
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    heads = {}
    for key, _, value in turns:
        heads.setdefault(key, value)
    expected = []
    for c in customers:
        key = next((k for k in (c * 3, c * 2, c) if k in heads), None)
        if key is not None:
            expected.append((c, key, heads[key]))
    found = queries.list_lmpop(spark, str(tmp_path)).collect()
    assert sorted((r["req"], r["key"], r["value"]) for r in found) == expected
    assert len(expected) == 6
