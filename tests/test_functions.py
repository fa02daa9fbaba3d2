import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import fuzzy as Z
from quillon.operators.scaling import Scaler, probe, wanted_ranks
from quillon.operators.scoring import fitness, measures_of
from quillon.plans.params import Params, parse_config, to_config
from quillon.plans.schema import parse_attribute, parse_header


def test_partition_points():
    sets = Z.partition(0.0, 1.0, 5)
    assert [s.mid for s in sets] == [0, 0.25, 0.5, 0.75, 1]
    assert Z.merge_points(sets) == [0.125, 0.375, 0.625, 0.875]
    with pytest.raises(ValueError):
        Z.partition(0, 1, 1)


def test_membership_and_shoulders():
    t = Z.Triangle(0, 0.25, 0.5)
    assert [t(v) for v in (0, 0.125, 0.25, 0.5)] == [0, 0.5, 1, 0]
    assert Z.Triangle(0, 0, 0.25)(-1) == Z.Triangle(0, 0, 0.25)(0) == Z.Triangle(0.75, 1, 1)(2) == 1


@given(st.floats(0, 1))
def test_memberships_add_up_to_one(v):
    assert sum(s(v) for s in Z.partition(0.0, 1.0, 5)) == pytest.approx(1)


def test_columns_agree_with_plain_functions(spark):
    sets = Z.partition(-1.0, 3.0, 4)
    rows = spark.range(-20, 50).select((F.col("id") / 10.0).alias("v"))
    got = rows.select("v", *[s.membership(F.col("v")).alias(f"m{j}") for j, s in enumerate(sets)], Z.crisp_label(F.col("v"), Z.merge_points(sets)).alias("label")).collect()
    for r in got:
        assert [r[f"m{j}"] for j in range(4)] == pytest.approx([s(r["v"]) for s in sets])
        assert r["label"] == sum(p <= r["v"] for p in Z.merge_points(sets))  # ties go up


def test_probe_stops_on_the_first_hit():
    cuts = [0.0] * 900 + [float(i) for i in range(1, 101)]
    assert probe(cuts, 0.0) == 499 and probe(cuts, 0.5) == 900 and probe(cuts, 1e9) == 1000


def test_wanted_ranks():
    assert wanted_ranks(10, 1000) == list(range(10))
    assert len(wanted_ranks(10**6, 1000)) == 1000 and wanted_ranks(0, 5) == [0]


@pytest.mark.parametrize("tie,expected", [("bisect", 0.499), ("left", 0.0)])
def test_duplicate_cuts(spark, tie, expected):
    cuts = [0.0] * 900 + [float(i) for i in range(1, 101)]
    s = Scaler({"v": cuts}, {"v": (0.0, 100.0)}, tie)
    df = spark.createDataFrame([(0.0,), (100.0,), (1000.0,), (None,), (50.5,)], "v double")
    got = [r["v"] for r in s.transform(df).collect()]
    assert got[0] == pytest.approx(expected) and got[1:4] == [pytest.approx(1.0), 1.0, None]
    assert got[4] == pytest.approx(0.9505)


def test_inverse_is_exact_on_the_grid():
    s = Scaler({"v": [1.0, 2.0, 4.0, 8.0]}, {"v": (0.0, 8.0)})
    assert [s.inverse_of(x, "v") for x in (0, 0.25, 0.5, 0.75, 1, 0.125)] == [0, 1, 2, 4, 8, 0.5]


def test_displacement_knows_its_neighbours():
    sets = Z.displaced(Z.partition(0.0, 1.0, 5), [0.5, 0.25, 0.75, 0.0, 1.0])
    assert [s.mid for s in sets] == [0, 0.1875, 0.5625, 0.625, 1.125]


def test_gray_distance():
    assert Z.gray_distance_of(3 / (2**30 - 1), 4 / (2**30 - 1), 30) == 1


def test_log_bounds_and_scale(spark):
    assert Z.log_bounds(1, math.e) == (0, 1) and Z.log_bounds(-1, 1)[1] == pytest.approx(math.log(3))
    got = spark.range(1).select(Z.log_scale(F.lit(0.0), 0.0), Z.log_scale(F.lit(-5.0), -1.0), Z.log_scale(F.lit(math.e), 1.0)).first()
    assert tuple(got) == (0, 0, pytest.approx(1))


def test_measures_and_fitness():
    assert measures_of([[8, 2], [1, 9]], "accuracy") == pytest.approx(0.85)
    assert measures_of([[8, 2], [1, 9]], "gm") == pytest.approx(math.sqrt(0.72))
    assert math.isnan(measures_of([[8, 2], [0, 0]], "gm"))
    assert fitness(1, 10, 4) == pytest.approx(1 - 0.15 * 10 / 7)


def test_attribute_kinds():
    assert parse_attribute("@attribute a-b/c real [0.5, 2]", 5).hi == 2
    assert parse_attribute("@attribute k integer[1,3]", 5).values == ("1", "2", "3")
    assert parse_attribute("@attribute k integer[1,30]", 5).is_real
    assert parse_attribute("@attribute k{x, y}", 5).values == ("x", "y")


HEADER = "@relation r\n@attribute a real[0,1]\n@attribute b{x,y}\n@attribute c{n,p}\n@inputs a,b\n@outputs c\n@numInstancesByClass 30,10\n"


def test_header():
    s = parse_header(HEADER, 5)
    assert s.costs() == [1, 3] and s.frequencies() == [0.75, 0.25] and s.default_class() == 0
    assert s.costs(False) == [1, 1]
    again = parse_header(s.to_header(), 5)
    assert again.variables == s.variables and again.counts == s.counts
    for broken in (HEADER.replace("@outputs c", ""), HEADER.replace("@outputs c", "@outputs a"), HEADER.replace("@numInstancesByClass 30,10", "")):
        with pytest.raises(ValueError):
            parse_header(broken, 5)


def test_config():
    p, unknown = parse_config("inference = wr\nweight_method = pcf\nmin_crisp_confidence = 0.7\nwhat = 1\nevolutionary = false\n")
    assert (p.inference, p.weight_method, p.min_crisp_confidence, p.evolutionary) == ("winning_rule", "pcf", 0.7, False) and unknown == ["what = 1"]
    assert parse_config(to_config(p))[0] == p
    with pytest.raises(ValueError):
        Params(max_attributes=2)


def test_rules_kept_uses_32_bit_products():
    p = Params(proportion_initial_rules_evolutionary=2)
    assert [p.rules_kept(k, 41, 5) for k in (1, 2, 3)] == [164, 247, 410]
    assert [p.rules_kept(k, 6, 3) for k in (1, 2, 3)] == [24, 36, 60]
