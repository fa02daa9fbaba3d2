"""Statistics of fuzzy sets on data, and sets moved to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.fuzzy import Triangle
from quillon.plans.schema import FuzzySchema


def set_statistics(df: DataFrame, schema: FuzzySchema, sets: dict[str, list[Triangle]]) -> DataFrame:
    """var, label, total, n: of the values within each set's closed base. One aggregate over one scan."""
    parts, cells = [], []
    for i, v in enumerate(schema.variables):
        for j, s in enumerate(sets.get(v.name, [])):
            x = F.col(f"`{v.name}`").cast("double")
            parts += [F.sum(F.when(s.supports(x), x)).alias(f"t_{i}_{j}"), F.count(F.when(s.supports(x), x)).alias(f"n_{i}_{j}")]
            cells.append(F.struct(F.lit(i).alias("var"), F.lit(j).alias("label"), F.coalesce(F.col(f"t_{i}_{j}"), F.lit(0.0)).alias("total"), F.col(f"n_{i}_{j}").alias("n")))
    return df.agg(*parts).select(F.inline(F.array(*cells)))


def recentred(stats: DataFrame, schema: FuzzySchema, sets: dict[str, list[Triangle]]) -> DataFrame:
    """var, label, l, m, r: each set moved so that its middle is its values' mean; one without values stays."""
    rows = [(i, j, s.left, s.mid, s.right) for i, v in enumerate(schema.variables) for j, s in enumerate(sets.get(v.name, []))]
    table = stats.sparkSession.createDataFrame(rows, "var int, label int, l double, m double, r double")
    by = F.when(F.col("n") > 0, F.col("total") / F.when(F.col("n") > 0, F.col("n")) - F.col("m")).otherwise(0.0)
    return F.broadcast(table).join(stats, ["var", "label"]).withColumn("by", by).select("var", "label", *[(F.col(c) + F.col("by")).alias(c) for c in ("l", "m", "r")])


def sets_from(rows: DataFrame, schema: FuzzySchema) -> dict[str, list[Triangle]]:
    out: dict[str, list[Triangle]] = {}
    for r in rows.orderBy("var", "label").collect():
        out.setdefault(schema.variables[r["var"]].name, []).append(Triangle(r["l"], r["m"], r["r"]))
    return out


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, lo, hi, n over equal widths between the least and the greatest value; the last bin is closed."""
    x = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = df.select(x.alias("x")).where("x is not null").join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + width * F.col("bin")).alias("lo"), (F.col("lo") + width * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
