from shelfline.registry import QUERIES


def test_profiles_join_the_lines_once(spark):
    """The parts of extended profiles read lines that are stored, not the star tables again."""
    plan = QUERIES["product_profiles_extended"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "stored-" in plan
