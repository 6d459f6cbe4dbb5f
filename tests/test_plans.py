"""Plans stay the ones that scale."""

import os

import pytest
from pyspark.sql import functions as F

from sluice import queries
from sluice.model import Campaign
from sluice.operators import campaigns, dedup, gates
from sluice.sources.events import from_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_broadcasts_campaigns_and_reads_few_columns(spark):
    text = plan(campaigns.match(from_table(spark, SF), campaigns.campaign_table(spark, queries.GATED), 5).select("event_id", "campaign_id"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text


def test_many_campaigns_are_not_broadcast_by_hint(spark):
    table = campaigns.campaign_table(spark, [Campaign("c", "t")])
    assert campaigns._sided(table, campaigns.BROADCAST_CAMPAIGNS + 1) is table and campaigns._sided(table, None) is table


def test_rules_run_without_python(spark):
    for name in ("q_rule_stats", "q_rule_mixed_types", "q_gates_combined", "q_ab_bucket", "q_json_extract", "q_enriched_rule"):
        text = plan(queries.QUERIES[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text, name


def test_first_occurrences_limit_before_the_shuffle(spark):
    text = plan(dedup.first_occurrences(from_table(spark, SF)))
    assert text.count("Exchange") == 1 and "WindowGroupLimit" in text


def test_one_campaign_with_most_events_is_cut_in_parts(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 0, "d").otherwise("c").alias("campaign_id"), F.lit(100).cast("long").alias("budget"), (F.col("id") % 3 > 0).alias("matched"), F.col("id").alias("ts"), F.col("id").alias("event_id"))
    assert gates.budget_cutoff(rows).first()["cutoff"]["ts"] == 149
    assert "_salt" in plan(gates.budget_cutoff(rows))
    text = plan(gates.budget_gate(rows, size=1))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    few = gates.budget_cutoff(rows, most=100)
    assert few.first()["cutoff"]["ts"] == 149 and "WindowGroupLimit" in plan(few)


def test_user_limits_are_taken_before_the_shuffle(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 0, "d").otherwise("c").alias("campaign_id"), (F.col("id") % 2).alias("user_id"), F.lit(3).alias("max_per_user"), F.col("id").alias("ts"), F.col("id").alias("event_id"))
    out = gates.user_limit(rows, kinds={True}, most=3)
    assert out.count() == 6 and plan(out).count("WindowGroupLimit") == 2
