from shelfline.operators import models as N
from shelfline.operators import segments as G
from shelfline.sources.lines import star_lines

SF = "/root/testdata/sf0.001"


def test_fits_read_features_that_are_made_once(spark, monkeypatch):
    """No pass of a fit goes back to the lines."""
    tx, kept, cut = star_lines(spark, SF), [], N.cut
    monkeypatch.setattr(N, "cut", lambda df: kept.append(df.columns) or cut(df))
    assert N.behavioral_segments(tx).count() > 0
    assert "weekend_ratio" in kept[0]
    N.train_choice_model(N.choice_features(tx, 365))
    assert "target" in kept[1]
    N.cluster_stability(G.behavioral_features(tx), N.BEHAVIOUR, 2, resamples=1)
    assert "weekend_ratio" in kept[2]
