"""All kinds and rules of one pass are those of the operators for one kind and rule."""

import random

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import fiducials
from pulsemill.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def waves(spark):
    random.seed(4)
    rows = [(fin, i, float(random.randint(-2, 2))) for fin in range(20) for i in range(fin)] + [(99, i, 1.0) for i in range(4)]
    return spark.createDataFrame(rows, "fin int, i int, v double")


def test_reversals_of_all_rules(waves):
    rules = {("positive", False): ["first", "max"], ("negative", True): ["first", "min"], ("both", False): ["max", "min"]}
    got = {tuple(r) for r in fiducials.ruled_reversals(waves, ["fin"], rules).select("kind", "backwards", "rule", "fin", "i", "v").collect()}
    wanted = {(k, b, r, *x) for (k, b), own in rules.items() for r in ("all", *own) for x in fiducials.slope_reversals(waves, ["fin"], k, b, r).select("fin", "i", "v").collect()}
    assert got == wanted


def test_crossings_of_all_rules(waves):
    kinds = ["positive", "negative", "both"]
    got = {tuple(r) for r in fiducials.ruled_crossings(waves, ["fin"], kinds).select("kind", "rule", "fin", "i", "v").collect()}
    wanted = {(k, r, *x) for k in kinds for r in ("all", "first", "last") for x in fiducials.zero_crossings(waves, ["fin"], k, rule=r).select("fin", "i", "v").collect()}
    assert got == wanted


@pytest.mark.parametrize("name", ["slope_reversals", "zero_crossing_rules"])
def test_one_branch_holds_all_rules(spark, name):
    """Branches of a union of equally dealt tables are held by one task together."""
    plan = QUERIES[name](spark, SF).select(F.count("*").over(fiducials.over(["fin"])))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


@pytest.mark.parametrize("name", ["free_days_28_7_2", "horizon_flags_1_2_7_28"])
def test_events_of_encounters_stay_in_their_tasks(spark, name):
    """As many tasks as configured, however small their compressed bytes are."""
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
