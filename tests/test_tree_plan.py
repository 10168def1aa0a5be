import shelfline.plans.tree as P
from shelfline.operators import affinity as A
from shelfline.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_splits_ask_for_no_pairs(spark, monkeypatch):
    """Importance, members and stability of splits don't count pairs of products, and the lines are joined once."""

    def never(*_):
        raise AssertionError("pairs were counted")

    kept = []
    monkeypatch.setattr(A, "similarity", never)
    monkeypatch.setattr(P, "stored", lambda df: kept.append(1) or df)
    for name in ("cdt_attribute_importance", "cdt_products", "cdt_stability"):
        assert QUERIES[name](spark, SF).count() >= 0
    assert len(kept) == 3
