"""Exact quantile cut points and the piecewise-linear probability transform, both ways."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.fuzzy import Triangle, log_scale
from quillon.plans.schema import FuzzySchema, Variable


def array_of(values: list[float]) -> Column:
    """One literal; an array of many literals would make every plan that holds it large."""
    return F.lit(np.array(values, np.float64))


def wanted_ranks(n: int, bins: int) -> list[int]:
    """0-based ranks of the cut points among n sorted values, each once."""
    return sorted({max(math.ceil((i / bins) * n - 1), 0) for i in range(1, bins + 1)})


def unpivot(df: DataFrame, names: list[str]) -> DataFrame:
    """var (place in names), value: one row for each non-null cell."""
    cells = F.array(*[F.struct(F.lit(i).alias("var"), F.col(f"`{n}`").cast("double").alias("value")) for i, n in enumerate(names)])
    return df.select(F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def quantile_cuts(df: DataFrame, names: list[str], bins: int = 1000, ranges: int | None = None) -> DataFrame:
    """var, idx, q: the cut points of each variable, in order.

    Equal values are counted on the tasks that read them. The different values are dealt to ranges by
    approximate quantiles, the ranges' totals give the rank at which each range begins, and ranks
    within the ranges are running counts. So no task ever sorts a whole variable, and ranks are exact.
    There are as many ranges as shuffle partitions, 64 at least.
    """
    spark = df.sparkSession
    ranges = ranges or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = unpivot(df, names)
    marks = cells.groupBy("var").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], max(1000, 4 * ranges)).alias("ends"), F.count("*").alias("n")).collect()
    if not marks:
        return spark.createDataFrame([], "var int, idx int, q double")
    ends, size = {r["var"]: sorted(set(r["ends"])) for r in marks}, {r["var"]: r["n"] for r in marks}
    lists = {var: np.array(e) for var, e in ends.items()}

    def smaller(var, value):
        """So many ends of its variable lie below each value."""
        import pyarrow as pa

        v, x = var.to_numpy(zero_copy_only=False), value.to_numpy(zero_copy_only=False)
        out = np.zeros(len(v), np.int32)
        for k, e in lists.items():
            out[v == k] = np.searchsorted(e, x[v == k])
        return pa.array(out)

    counts = cells.groupBy("var", "value").agg(F.count("*").alias("n")).withColumn("range", vectorized(smaller, "int")("var", "value"))
    counts = counts.persist()
    try:
        totals = counts.groupBy("var", "range").agg(F.sum("n").alias("n")).collect()
        before = {}
        for var in size:
            at = 0
            for r in sorted((r["range"], r["n"]) for r in totals if r["var"] == var):
                before[var, r[0]] = at
                at += r[1]
        starts = spark.createDataFrame([(v, r, b, size[v]) for (v, r), b in before.items()], "var int, range int, before long, total long")
        w = Window.partitionBy("var", "range").orderBy("value")
        ranked = counts.join(F.broadcast(starts), ["var", "range"]).withColumn("upto", F.col("before") + F.sum("n").over(w)).withColumn("from", F.col("upto") - F.col("n"))
        # which of the wanted ranks fall on this value: tried for the few i around
        rank = lambda i: F.greatest(F.ceil((i / F.lit(float(bins))) * F.col("total") - 1), F.lit(0))
        lo = F.greatest(F.floor(F.col("from") * bins / F.col("total")) - 1, F.lit(1))
        hi = F.least(F.ceil((F.col("upto") + 1) * bins / F.col("total")) + 1, F.lit(bins))
        on = F.array_distinct(F.transform(F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda i: (rank(i) >= F.col("from")) & (rank(i) < F.col("upto"))), rank))
        cuts = ranked.select("var", F.explode(on).alias("rank"), F.col("value").alias("q")).collect()  # at most bins a variable
    finally:
        counts.unpersist()
    rows, last = [], {}
    for r in sorted((r["var"], r["rank"], r["q"]) for r in cuts):
        last[r[0]] = last.get(r[0], -1) + 1
        rows.append((r[0], last[r[0]], r[2]))
    return spark.createDataFrame(rows, "var int, idx int, q double").coalesce(1)


def probe(cuts: list[float], v: float) -> int:
    """Where a halving search for v stops: on an equal cut point at once, else at the number of smaller ones."""
    a, b = 0, len(cuts)
    while a < b:
        k = (a + b - 1) // 2
        if cuts[k] == v:
            return k
        a, b = (a, k) if v < cuts[k] else (k + 1, b)
    return a


def vectorized(run, kind: str):
    """An Arrow function of whole columns; a filter on its outcome does not make it run again."""
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR).asNondeterministic()


@dataclass(frozen=True)
class Scaler:
    """Cut points of the real variables, by name. They belong to the model: new data use the old ones."""

    cuts: dict[str, list[float]]
    bounds: dict[str, tuple[float, float]]
    tie: str = "bisect"

    @staticmethod
    def fit(df: DataFrame, schema: FuzzySchema, bins: int = 1000, tie: str = "bisect") -> Scaler:
        names = [v.name for v in schema.reals]
        cuts: dict[str, list[float]] = {n: [] for n in names}
        for r in quantile_cuts(df, names, bins).orderBy("var", "idx").collect() if names else []:
            cuts[names[r["var"]]].append(r["q"])
        return Scaler(cuts, {v.name: (v.lo, v.hi) for v in schema.reals}, tie)

    def transform(self, df: DataFrame, only: list[str] | None = None, engine: str = "arrow") -> DataFrame:
        """Each real column as its place among the cut points, interpolated, in [0, 1].

        `arrow` searches for blocks of values in numpy; `sql` is the same in higher-order functions, for sessions
        without Python workers. Both work on streams.
        """
        make = self.column if engine == "sql" else lambda v, n: vectorized(self.places(n), "double")(v)
        return df.withColumns({n: make(F.col(f"`{n}`").cast("double"), n) for n in self.cuts if only is None or n in only})

    def hits(self, cuts: list[float]) -> dict[int, int]:
        """Where the search stops for the value of each cut point, if not on the first of equal ones."""
        found = {k: probe(cuts, c) for k, c in enumerate(cuts) if k == 0 or cuts[k - 1] != c} if self.tie == "bisect" else {}
        return {k: h for k, h in found.items() if k != h}

    def places(self, name: str):
        """The transform of one variable as a function of an Arrow column."""
        cuts, lo, q = np.array(self.cuts[name], float), float(self.bounds[name][0]), len(self.cuts[name])
        to = np.arange(q)
        for k, h in self.hits(self.cuts[name]).items():
            to[k] = h
        left = np.concatenate([[lo], cuts])  # the left end of each bin
        right = np.append(cuts, np.nan)

        def run(column):
            import pyarrow as pa

            none = column.is_null().to_numpy(zero_copy_only=False)
            x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            if not q:
                return pa.array(np.ones(len(x)), mask=none)
            i = np.searchsorted(cuts, x)
            hit = right[i] == x
            i[hit] = to[i[hit]]
            y1, wide = i / q, right[i] - left[i]
            with np.errstate(invalid="ignore", divide="ignore"):
                inside = np.where(wide > 0, y1 + (x - left[i]) * ((i + 1) / q - y1) / wide, y1)
            return pa.array(np.where(i >= q, 1.0, inside), mask=none)

        return run

    def column(self, v: Column, name: str) -> Column:
        """A halving search as a fold over its steps: a small expression, also where a filter repeats it."""
        cuts, lo = self.cuts[name], self.bounds[name][0]
        q = len(cuts)
        if not q:
            return F.when(v.isNotNull(), 1.0)
        lists = array_of(cuts)
        steps = F.lit(np.array([2**k for k in range(q.bit_length() - 1, -1, -1)], np.int32))

        def place(x):
            smaller = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= q) & F.coalesce(F.get(lists, at + step - 1) < x, F.lit(False)), at + step).otherwise(at))
            return F.transform(F.array(smaller), lambda i: on(x, i))[0]

        def on(x, i):
            return F.transform(F.array(hit(x, i)), lambda k: between(x, k))[0]

        def hit(x, i):
            hits = self.hits(cuts)
            if not hits:
                return i
            to = F.lit(np.array([hits.get(k, k) for k in range(q)], np.int32))
            return F.when(F.get(lists, i) == x, F.get(to, i)).otherwise(i)

        def between(x, i):
            x1 = F.when(i == 0, F.lit(float(lo))).otherwise(F.get(lists, i - 1))
            x2, y1, y2 = F.get(lists, i), i / F.lit(float(q)), (i + 1) / F.lit(float(q))
            inside = F.when(x2 > x1, y1 + (x - x1) * (y2 - y1) / F.when(x2 > x1, x2 - x1)).otherwise(y1)
            return F.when(i >= q, 1.0).otherwise(inside)

        return F.when(v.isNotNull(), F.transform(F.array(v), place)[0])

    def inverse(self, v: Column, name: str) -> Column:
        """From [0, 1] back; exact on the grid, interpolated in the value's own bin between."""
        cuts, (lo, hi) = self.cuts[name], self.bounds[name]
        q = len(cuts)
        lists = array_of(cuts)
        scaled = v * float(q)
        i = F.least(F.floor(scaled), F.lit(q - 1)).cast("int")
        x1 = F.when(i == 0, F.lit(float(lo))).otherwise(F.get(lists, i - 1))
        return F.when(v >= 1, float(hi)).when(v <= 0, float(lo)).otherwise(x1 + (scaled - i) * (F.get(lists, i) - x1))

    def inverse_of(self, v: float, name: str) -> float:
        cuts, (lo, hi) = self.cuts[name], self.bounds[name]
        if v >= 1 or v <= 0:
            return float(hi if v >= 1 else lo)
        i = min(int(v * len(cuts)), len(cuts) - 1)
        x1 = cuts[i - 1] if i else lo
        return x1 + (v * len(cuts) - i) * (cuts[i] - x1)

    def translate(self, sets: list[Triangle], name: str) -> list[Triangle]:
        """Fuzzy sets on the uniform scale as sets on the original one."""
        back = lambda x: self.inverse_of(x, name)
        return [Triangle(back(s.left), back(s.mid), back(s.right)) for s in sets]


def log_transform(df: DataFrame, variables: list[Variable]) -> DataFrame:
    return df.withColumns({v.name: log_scale(F.col(f"`{v.name}`").cast("double"), v.lo) for v in variables if v.is_real})


def scale(df: DataFrame, schema: FuzzySchema, mode: str, scaler: Scaler | None = None, bins: int = 1000) -> tuple[DataFrame, FuzzySchema, Scaler | None]:
    """Scaled data, the scaled schema, and the scaler if the mode is `uniform`."""
    if mode == "uniform":
        scaler = scaler or Scaler.fit(df, schema, bins)
        return scaler.transform(df), schema.scaled("uniform"), scaler
    return (log_transform(df, list(schema.variables)) if mode == "log" else df), schema.scaled(mode), None
