"""The registered learners are the published ones: boosted trees with all their rounds."""

import pytest

from checks import queries as Q
from firegrid.operators import learning as L

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["m5_boosted_trees", "m12_multiday_training", "m13_leave_one_day_out"])
def test_boosted_trees_with_all_rounds(spark, monkeypatch, name):
    def stop(*args, **kwargs):
        raise Asked(next(x for x in [*args, *kwargs.values()] if isinstance(x, L.ClassifierConfig)))

    for owner, function in ((Q.L, "fit_classifier"), (Q.DP, "day_products"), (Q.L, "leave_one_scene_out")):
        monkeypatch.setattr(owner, function, stop)
    with pytest.raises(Asked) as asked:
        Q.QUERIES[name](spark, SF)
    assert asked.value.args[0] == L.multiday_config()
    assert (asked.value.args[0].kind, asked.value.args[0].rounds) == ("boosted", 200)
