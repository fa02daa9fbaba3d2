"""Weights, conflicts, selection and the form of rules."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.fuzzy import Triangle, nominal_code
from quillon.operators import itemsets as I
from quillon.plans.params import Params
from quillon.plans.schema import FuzzySchema


def slots(schema: FuzzySchema, labels: int) -> dict[int, int]:
    """Place of each item in the membership vector; place 0 holds 1.0, for rules with fewer items."""
    items = [i * I.STEP + j for i, v in enumerate(schema.variables) for j in range(v.size(labels))]
    return {item: k for k, item in enumerate(items, 1)}


def memberships(schema: FuzzySchema, sets: dict[str, list[Triangle]]) -> Column:
    """array<double>: 1.0, then the membership in every label of every variable. Missing values belong to none."""
    out = [F.lit(1.0)]
    for v in schema.variables:
        c = F.col(f"`{v.name}`")
        if v.is_real:
            out += [F.coalesce(s.membership(c.cast("double")), F.lit(0.0)) for s in sets[v.name]]
        else:
            code = nominal_code(c, v.values)
            out += [(code == j).cast("double") for j in range(len(v.values))]
    return F.array(*out)


def packed(rules: list[list[int]], schema: FuzzySchema, labels: int, width: int) -> np.ndarray:
    """rules x width places in the membership vector, padded with 0."""
    at = slots(schema, labels)
    out = np.zeros((len(rules), width), np.int32)
    for r, items in enumerate(rules):
        out[r, : len(items)] = [at[i] for i in items]
    return out


def products(mu: np.ndarray, places: np.ndarray) -> np.ndarray:
    """rows x rules: the product of each rule's memberships."""
    out = mu[:, places[:, 0]]
    for k in range(1, places.shape[1]):
        out = out * mu[:, places[:, k]]
    return out


def class_sums(mu: np.ndarray, cls: np.ndarray, places: np.ndarray, total: np.ndarray, rows: int = 1024, rules: int = 256) -> None:
    """Adds each rule's matching over each class to total (rules x classes), a small block of rows and rules at a time."""
    for i in range(0, len(mu), rows):
        own = np.ascontiguousarray(mu[i : i + rows].T)
        one = (cls[i : i + rows, None] == np.arange(total.shape[1])).astype(float)
        for r in range(0, len(places), rules):
            p = places[r : r + rules]
            out = own[p[:, 0]]
            for k in range(1, p.shape[1]):
                out *= own[p[:, k]]
            total[r : r + rules] += out @ one


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def class_matching(df: DataFrame, schema: FuzzySchema, sets: dict, rules: list[list[int]], p: Params, engine: str = "arrow", most_rules: int = 100_000) -> DataFrame:
    """rule, cls, m: the cost-weighted sum of every rule's matching over each class.

    The rules are sent to the tasks, at most `most_rules` of them in one pass over the data (12 bytes each); there
    are more only before the choice of the best, with very many variables. `arrow` multiplies blocks of rows
    by blocks of rules in numpy and hands on one sum for each rule and class of a task; `sql` is the
    same as a broadcast product with partial sums, for sessions without Python workers.
    """
    if len(rules) > most_rules:
        slices = [(i, class_matching(df, schema, sets, rules[i : i + most_rules], p, engine, most_rules)) for i in range(0, len(rules), most_rules)]
        return reduce(DataFrame.unionByName, [m.withColumn("rule", F.col("rule") + i) for i, m in slices])
    labels, width = p.num_linguistic_labels, max([len(r) for r in rules] or [1])
    rows = df.select(memberships(schema, sets).alias("mu"), I.class_code(schema).alias("cls")).where("cls >= 0")
    places, costs, spark = packed(rules, schema, labels, width), schema.costs(p.cost_sensitive), df.sparkSession
    if engine == "sql":
        table = spark.createDataFrame([(r, *map(int, x)) for r, x in enumerate(places)], "rule int, " + ", ".join(f"i{k} int" for k in range(width)))
        m = F.get("mu", F.col("i0"))
        for k in range(1, width):
            m = m * F.get("mu", F.col(f"i{k}"))
        sums = rows.crossJoin(F.broadcast(table)).withColumn("m", m).where("m > 0").groupBy("rule", "cls").agg(F.sum("m").alias("m"))
    else:
        box, classes = spark.sparkContext.broadcast(places), len(costs)

        def run(batches):
            import pyarrow as pa

            total = np.zeros((len(box.value), classes))
            for b in batches:
                class_sums(matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), box.value, total)
            r, c = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[r, c])], ["rule", "cls", "m"])

        sums = rows.mapInArrow(run, "rule int, cls int, m double").groupBy("rule", "cls").agg(F.sum("m").alias("m"))
    return sums.withColumn("m", F.col("m") * I.cost_of(F.col("cls"), schema, p))


def weighted(matching: DataFrame, rules: DataFrame, n: int, p: Params) -> DataFrame:
    """rule, itemset, len, cls, weight, support, conf for every class that a rule covers.

    rules: rule, itemset, len, classes. The weight is the certainty factor, less that of the other classes if
    penalized. Support is over the plain number of examples.
    """
    total = F.sum("m").over(Window.partitionBy("rule"))
    rows = matching.withColumn("total", total).join(F.broadcast(rules), "rule").where(F.array_contains("classes", F.col("cls")) & (F.col("total") > 0))
    cf = F.col("m") / F.col("total")
    weight = (2 * F.col("m") - F.col("total")) / F.col("total") if p.weight_method == "pcf" else cf
    return rows.select("rule", "itemset", "len", "cls", weight.alias("weight"), (F.col("m") / n).alias("support"), cf.alias("conf"))


def resolved(rows: DataFrame) -> DataFrame:
    """The class of greatest weight of each rule, the first of several."""
    best = F.max(F.struct("weight", (-F.col("cls")).alias("first"), "support", "conf"))
    return rows.groupBy("rule", "itemset", "len").agg(best.alias("b")).select("rule", "itemset", "len", (-F.col("b.first")).alias("cls"), "b.weight", "b.support", "b.conf")


def fit_rules(rows: DataFrame, schema: FuzzySchema, p: Params) -> DataFrame:
    return rows.where((F.col("weight") > 0) & (F.col("support") >= p.fuzzy_support / (len(schema.classes) * F.col("len"))) & (F.col("conf") >= p.min_fuzzy_confidence))


def top_rules(rows: DataFrame, schema: FuzzySchema, p: Params) -> DataFrame:
    """The heaviest rules of each length (and class, if cost-sensitive)."""
    by = ["cls", "len"] if p.cost_sensitive else ["len"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "itemset"))
    most = F.get(F.array(*[F.lit(p.rules_kept(k, len(schema.variables), len(schema.classes))) for k in range(1, p.max_attributes + 1)]), F.col("len") - 1)
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def numbered(rows: DataFrame, name: str = "rule") -> DataFrame:
    """Numbers from 0 in the order of length, then itemset: rules are few, and the order is always the same."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy("len", "itemset")) - 1)


def rule_text(rows: DataFrame, schema: FuzzySchema) -> DataFrame:
    """rule, text: IF a IS L_2 AND b IS tcp THEN CLASS c WITH RW = w."""
    conditions = F.replace(F.replace(I.item_text(F.col("itemset"), schema), F.lit(" & "), F.lit(" AND ")), F.lit("="), F.lit(" IS "))
    cls = F.get(F.array(*[F.lit(c) for c in schema.classes]), F.col("cls"))
    return rows.select("rule", F.concat(F.lit("IF "), conditions, F.lit(" THEN CLASS "), cls, F.lit(" WITH RW = "), F.format_string("%.4f", "weight")).alias("text"))


def statistics(rows: DataFrame, schema: FuzzySchema) -> DataFrame:
    """cls, class, rules, mean length and weight; classes without rules have 0 and null."""
    table = rows.sparkSession.createDataFrame(list(enumerate(schema.classes)), "cls int, class string")
    own = rows.groupBy("cls").agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), F.avg("weight").alias("mean_weight"))
    return F.broadcast(table).join(own, "cls", "left").select("cls", "class", F.coalesce("n", F.lit(0)).alias("n_rules"), "mean_len", "mean_weight")
