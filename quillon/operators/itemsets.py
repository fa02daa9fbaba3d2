"""Cost-weighted itemsets of crisp labels: cells, all short subsets, support, thresholds and pruning.

An item is (variable, label) as one number, var * STEP + label; an itemset is its sorted array of items.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.fuzzy import Triangle, crisp_label, merge_points, nominal_code, partition
from quillon.plans.params import Params
from quillon.plans.schema import FuzzySchema

STEP = 1 << 12


def fuzzy_sets(schema: FuzzySchema, labels: int) -> dict[str, list[Triangle]]:
    return {v.name: partition(v.lo, v.hi, labels) for v in schema.reals}


def label_columns(schema: FuzzySchema, sets: dict[str, list[Triangle]]) -> list[Column]:
    return [crisp_label(F.col(f"`{v.name}`").cast("double"), merge_points(sets[v.name])) if v.is_real else nominal_code(F.col(f"`{v.name}`"), v.values) for v in schema.variables]


def class_code(schema: FuzzySchema) -> Column:
    return nominal_code(F.col(f"`{schema.label}`"), schema.classes)


def labelled(df: DataFrame, schema: FuzzySchema, sets: dict[str, list[Triangle]], on_missing: str = "drop") -> DataFrame:
    """labels array<int>, cls int. Rows of an unknown class are dropped, or raise."""
    rows = df.select(F.array(*label_columns(schema, sets)).alias("labels"), class_code(schema).alias("cls"))
    if on_missing == "error":
        return rows.withColumn("cls", F.when(F.col("cls") >= 0, F.col("cls")).otherwise(F.raise_error(F.lit(f"unknown class in {schema.label}")).cast("int")))
    return rows.where("cls >= 0")


def cells(df: DataFrame, schema: FuzzySchema, sets: dict[str, list[Triangle]]) -> DataFrame:
    """labels, cls, n: equal rows as one, before anything is expanded."""
    return labelled(df, schema, sets).groupBy("labels", "cls").agg(F.count("*").alias("n"))


def cost_of(cls: Column, schema: FuzzySchema, p: Params) -> Column:
    return F.get(F.array(*[F.lit(float(c)) for c in schema.costs(p.cost_sensitive)]), cls)


def itemsets(counts: DataFrame, schema: FuzzySchema, p: Params) -> DataFrame:
    """itemset, len, cls, cov: the cost-weighted count of every subset of up to max_attributes items.

    Integer counts are summed, the cost comes last. Missing and unknown values are no items. Each row keeps
    its own items and is exploded over the subsets of places, one literal; equal itemsets are summed on the
    tasks before they are moved.
    """
    v = len(schema.variables)
    places = [list(c) for k in range(1, min(p.max_attributes, v) + 1) for c in combinations(range(v), k)]
    table = F.from_json(F.lit(json.dumps(places)), "array<array<int>>")
    item = lambda i: i * STEP + F.get(F.col("labels"), i)
    own = counts.select("*", F.explode(table).alias("places")).where(F.forall("places", lambda i: F.coalesce(F.get(F.col("labels"), i) >= 0, F.lit(False))))
    sums = own.select(F.transform("places", item).alias("itemset"), "cls", "n").groupBy("itemset", "cls").agg(F.sum("n").alias("n"))
    return sums.select("itemset", F.size("itemset").alias("len"), "cls", (F.col("n") * cost_of(F.col("cls"), schema, p)).alias("cov"))


def total_coverage(counts: DataFrame, schema: FuzzySchema, p: Params) -> float:
    per = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    costs = schema.costs(p.cost_sensitive)
    return sum(n * costs[c] for c, n in sorted(per.items()))


def candidates(covered: DataFrame, total: float) -> DataFrame:
    """One row an itemset: its support, best class (the first of several) and that class's share."""
    best = F.max(F.struct("cov", (-F.col("cls")).alias("first")))
    rows = covered.groupBy("itemset", "len").agg(F.sum("cov").alias("sum"), best.alias("best"), F.array_sort(F.collect_list("cls")).alias("classes"))
    return rows.select("itemset", "len", (F.col("sum") / total).alias("support"), (-F.col("best.first")).alias("cls"), (F.col("best.cov") / F.col("sum")).alias("conf"), "classes")


def frequent(found: DataFrame, schema: FuzzySchema, p: Params) -> DataFrame:
    return found.where(F.col("support") > p.crisp_support / (len(schema.classes) * F.col("len")))


def thresholds(found: DataFrame, p: Params) -> DataFrame:
    """(cls,) len, threshold: the confidence at the middle of each group, but not over min_crisp_confidence."""
    by = ["cls", "len"] if p.cost_sensitive else ["len"]
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.desc("conf"), "itemset")) - 1
    at = F.least(F.ceil(p.median * F.count("*").over(w)), F.count("*").over(w) - 1)
    rows = found.withColumns({"rank": rank, "at": at}).where("rank = at")
    return rows.select(*by, F.least(F.col("conf"), F.lit(p.min_crisp_confidence)).alias("threshold"))


def top(found: DataFrame, p: Params) -> DataFrame:
    by = ["cls", "len"] if p.cost_sensitive else ["len"]
    return found.join(F.broadcast(thresholds(found, p)), by).where("conf >= threshold").drop("threshold")


def pruned(found: DataFrame) -> DataFrame:
    """Rules without those that a shorter rule makes needless.

    For each item, the shortest rule with it (by length, then itemset) leads; a longer rule that holds all
    the leader's items and is no surer goes. One turn is enough, as only longer rules go and a leader is
    never longer than another. The leader is a grouped minimum, so a common item needs no single task.
    """
    own = found.select("itemset", "len", "conf", F.explode("itemset").alias("item"))
    lead = own.groupBy("item").agg(F.min(F.struct("len", "itemset", "conf")).alias("lead"))
    held = own.join(lead, "item")
    gone = held.where((F.size(F.array_except("lead.itemset", "itemset")) == 0) & (F.col("len") > F.col("lead.len")) & (F.col("conf") <= F.col("lead.conf"))).select("itemset").distinct()
    return found.join(gone, "itemset", "left_anti")


def item_text(itemset: Column, schema: FuzzySchema) -> Column:
    """`a=L_2 & b=tcp`: the form in which itemsets are compared and shown."""
    names = F.array(*[F.lit(v.name) for v in schema.variables])
    # nominal values by variable; the labels of reals are numbered
    words = F.array(*[F.array(*[F.lit(x) for x in v.values]).cast("array<string>") for v in schema.variables])
    one = lambda x: F.concat(F.get(names, F.floor(x / STEP).cast("int")), F.lit("="), F.coalesce(F.get(F.get(words, F.floor(x / STEP).cast("int")), x % STEP), F.concat(F.lit("L_"), (x % STEP).cast("string"))))
    return F.array_join(F.transform(itemset, one), " & ")
