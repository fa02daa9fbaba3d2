import duckdb
import pytest

import __spark_entry__ as entry
from quillon import oracles, queries
from quillon.operators import rules as R
from quillon.operators import scaling as C

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "documents", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df, twin = entry.queries()[name](spark, SF), duck.sql(oracles.SQL[name])
    cols = sorted(df.columns)
    assert sorted(twin.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    at = [twin.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(oracles.SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(oracles.SQL) == {"chc_select", "chc_tune"}


def test_many_rules_go_in_slices(spark):
    st = queries.stages_g(spark, SF)
    rules = [r["itemset"] for r in st.pruned().orderBy("rule").select("itemset").collect()]
    one, many = ({(r["rule"], r["cls"]): r["m"] for r in R.class_matching(st.data, st.schema, st.sets, rules, st.p, most_rules=m).collect()} for m in (10**6, 50))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) <= 1e-9 * abs(one[k]) for k in one)


def test_transform_is_the_same_in_both_engines(spark):
    cuts = [0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 5.0, 5.0, 5.0, 5.0, 9.0]
    values = [-3.0, 0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 9.0, 10.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for tie in ("bisect", "left"):
        for own in (cuts, []):
            scaler = C.Scaler({"x": own}, {"x": (-1.0, 9.0)}, tie)
            a, b = ([r["x"] for r in scaler.transform(df, engine=e).collect()] for e in ("arrow", "sql"))
            assert a == b


def test_scaled_ties_round_as_in_sql(spark, tmp_path):
    """Every second price lies an odd number of 2000ths between its cut points: the seventh decimal is a 5."""
    path = f"{tmp_path}/lineitem.parquet"
    price = "CAST(2000 * i + CASE WHEN j = 0 THEN 2 * ((i * 37) % 999) + 1 - 2000 ELSE 0 END AS DOUBLE)"
    duckdb.sql(f"copy (select 1.0::double l_quantity, {price} l_extendedprice, 0.05::double l_discount, 0.02::double l_tax, 'A' l_returnflag, 'F' l_linestatus from range(1, 1001) a(i), range(2) b(j)) to '{path}'")
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{path}'")
    got = sorted(map(tuple, entry.queries()["pit_transform"](spark, str(tmp_path)).select("var", "value", "n").collect()))
    assert got == sorted(c.sql(oracles.SQL["pit_transform"]).select("var, value, n").fetchall())
    assert sum(r[0] == 1 for r in got) > 1900


def test_rounded_is_the_rounding_of_sql(spark):
    x = [s * (k + 0.5) / 10**6 for k in range(3000) for s in (1, -1)] + [0.0, 0.49999999999999994e-6, 1 / 3, 123456789.0123455]
    want = [r[0] for r in duckdb.execute("select round(v, 6) from (select unnest(?::double[]) as v)", [x]).fetchall()]
    df = spark.createDataFrame([(v,) for v in x], "v double").coalesce(1)
    assert [r[0] for r in df.select(queries.rounded("v", 6)).collect()] == want == [queries.rounded(v, 6) for v in x]
    assert df.limit(1).select(queries.rounded(queries.F.lit(None).cast("double"), 6)).first()[0] is None
