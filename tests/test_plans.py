"""No query reads its files again and again: parts that are used several times are built once."""

import pytest

from shelfline.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: File scans of a plan at most; sales lines are three tables.
MOST = 30
#: Those with the largest plans.
LARGEST = ["rfm_segments", "segment_growth", "insight_list", "opportunity_list", "promotion_insights", "promo_manager", "promo_waterfall", "false_discovery_rate", "pricing_manager", "product_profiles_extended", "switching_opportunities", "strategy_scorecard", "category_rules", "pricing_insights"]


@pytest.mark.parametrize("name", LARGEST)
def test_file_scans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan ") <= MOST
