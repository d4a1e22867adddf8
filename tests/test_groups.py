import pytest

from flowlens.operators import correlate as C
from flowlens.queries import QUERIES

FACTS = "alert_id long, source_ip string, destination_ip string, event_start long, event_end long, risk double, alert_type string, reason string, verdict string"


@pytest.mark.parametrize("name", ["cor3_score", "cor4_alert_groups", "set4_merge_member_sets", "hyp1_gate", "hyp4_hypotheses", "join4_alert_relations", "join5_job_lineage", "join10_group_members"])
def test_rows_of_members_do_not_carry_the_set(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange hashpartitioning(members#" not in plan


def test_groups_of_equal_members(spark):
    rows = [(i, "10.0.0.1", f"198.51.100.{i % 2}", i, i + 1, 0.9, "multi_engine_suspicion", "AUTH_FAILURE", None) for i in range(6)]
    got = {tuple(r["members"]): (r["entities"], r["alerts"]) for r in C.alert_groups(spark.createDataFrame(rows, FACTS), 60.0, 0.0).collect()}
    odd = lambda k: ([f"destination_ip:198.51.100.{k}", f"pair:10.0.0.1->198.51.100.{k}"], 3)
    assert got == {("0", "1", "2", "3", "4", "5"): (["source_ip:10.0.0.1"], 6), ("0", "2", "4"): odd(0), ("1", "3", "5"): odd(1)}
