from flowlens.plans import models as P


def test_parts_are_joined_once(spark, sf):
    parts = P.parts(spark, sf)
    assert {n: p.count() > 0 for n, p in parts.items()} == dict.fromkeys(("train", "validation", "test"), True)
    assert "Join" not in parts["train"]._jdf.queryExecution().executedPlan().toString()
