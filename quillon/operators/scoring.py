"""Inference with a rule base, confusion matrices, accuracy measures and rule-subset fitness."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import itemsets as I
from quillon.operators.rules import matrix, memberships, packed, products
from quillon.plans.schema import FuzzySchema


@dataclass(frozen=True)
class Rule:
    items: tuple[int, ...]
    cls: int
    weight: float


def choose(matching: np.ndarray, cls: np.ndarray, classes: int, default: int, inference: str) -> tuple[np.ndarray, np.ndarray]:
    """Predicted class and score of each row of a rows x rules matrix of weighted matchings.

    Winning rule: the greatest matching, the first of several. Additive: the greatest sum by class, the first of
    several. Rows that match nothing get the default class and 0.
    """
    n = len(matching)
    if not matching.shape[1]:
        return np.full(n, default, np.int32), np.zeros(n)
    if inference == "winning_rule":
        at = matching.argmax(axis=1)
        score = matching[np.arange(n), at]
        return np.where(score > 0, cls[at], default).astype(np.int32), np.maximum(score, 0)
    sums = np.stack([matching[:, cls == c].sum(axis=1) for c in range(classes)], axis=1)
    at = sums.argmax(axis=1)
    score = sums[np.arange(n), at]
    return np.where(score > 0, at, default).astype(np.int32), np.maximum(score, 0)


def predicted(df: DataFrame, schema: FuzzySchema, sets: dict, rules: list[Rule], labels: int, inference: str = "winning_rule", engine: str = "arrow") -> DataFrame:
    """df with `prediction` (class number) and `score`. No row is moved.

    `arrow` takes blocks of rows against all rules in numpy; `sql` walks the rules in a higher-order
    function. Both work on streams.
    """
    mu, default = memberships(schema, sets), schema.default_class()
    if engine == "sql":
        got = _by_functions(mu, rules, schema, labels, default, inference)
    else:
        width = max([len(r.items) for r in rules] or [1])
        places = packed([list(r.items) for r in rules], schema, labels, width)
        weights, cls, n = np.array([r.weight for r in rules]), np.array([r.cls for r in rules], np.int64), len(schema.classes)

        def run(column):
            import pyarrow as pa

            m, out = matrix(column), []
            for i in range(0, len(m), 4096):
                out.append(choose(products(m[i : i + 4096], places) * weights, cls, n, default, inference))
            c, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int32), np.zeros(0))
            return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)), pa.array(s)], ["cls", "score"])

        # a filter on the outcome must not be pushed below the function, which would run again for it
        got = F.arrow_udf(run, "struct<cls:int,score:double>", F.ArrowUDFType.SCALAR).asNondeterministic()(mu)
    return df.withColumn("_got", got).withColumns({"prediction": F.col("_got.cls"), "score": F.col("_got.score")}).drop("_got")


def _by_functions(mu: Column, rules: list[Rule], schema: FuzzySchema, labels: int, default: int, inference: str) -> Column:
    if not rules:
        return F.struct(F.lit(default).alias("cls"), F.lit(0.0).alias("score"))
    width = max(len(r.items) for r in rules)
    places = packed([list(r.items) for r in rules], schema, labels, width)
    table = F.array(*[F.struct(*[F.lit(int(x)).alias(f"i{k}") for k, x in enumerate(row)], F.lit(float(r.weight)).alias("w"), F.lit(r.cls).alias("c"), F.lit(-n).alias("first")) for n, (r, row) in enumerate(zip(rules, places))])

    def on(m):
        def match(r):
            out = r["w"]
            for k in range(width):
                out = out * F.get(m, r[f"i{k}"])
            return out

        if inference == "winning_rule":
            best = F.array_max(F.transform(table, lambda r: F.struct(match(r).alias("score"), r["first"].alias("first"), r["c"].alias("cls"))))
        else:
            best = F.array_max(F.array(*[F.struct(F.aggregate(F.filter(table, _is_class(c)), F.lit(0.0), lambda s, r: s + match(r)).alias("score"), F.lit(-c).alias("first"), F.lit(c).alias("cls")) for c in range(len(schema.classes))]))
        return F.transform(F.array(best), lambda b: F.when(b["score"] > 0, F.struct(b["cls"].alias("cls"), b["score"].alias("score"))).otherwise(F.struct(F.lit(default).alias("cls"), F.lit(0.0).alias("score"))))[0]

    return F.transform(F.array(mu), on)[0]


def _is_class(c: int):
    return lambda r: r["c"] == c


def confusion(scored: DataFrame, schema: FuzzySchema) -> DataFrame:
    """real, pred, n for all pairs of classes. scored needs the label column and `prediction`."""
    n = len(schema.classes)
    spark = scored.sparkSession
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("real"), (F.col("id") % n).cast("int").alias("pred"))
    counts = scored.select(I.class_code(schema).alias("real"), F.col("prediction").alias("pred")).groupBy("real", "pred").agg(F.count("*").alias("n"))
    same = F.expr("p.real <=> c.real and p.pred <=> c.pred")
    return F.broadcast(pairs.alias("p")).join(counts.alias("c"), same, "left").select("p.real", "p.pred", F.coalesce("c.n", F.lit(0)).alias("n"))


def measures(matrix_rows: DataFrame, ignore_absent: bool = False) -> DataFrame:
    """accuracy, gm, avg_accuracy from real, pred, n. A class without examples makes the means NaN, unless ignored."""
    per = matrix_rows.groupBy("real").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("real") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    rate = F.when(F.col("n") > 0, F.col("hit") / F.when(F.col("n") > 0, F.col("n"))).otherwise(F.lit(float("nan")))
    rows = per.withColumn("rate", rate)
    rows = rows.where(~F.isnan("rate")) if ignore_absent else rows
    return rows.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.pow(F.product("rate"), 1 / F.count("*")).alias("gm"), F.avg("rate").alias("avg_accuracy"))


def measures_of(table: np.ndarray, measure: str) -> float:
    """The same of a class x class array (real by row); NaN for absent classes."""
    table = np.asarray(table, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        rates = np.diag(table) / table.sum(axis=1)
    if measure == "gm":
        return float(np.prod(rates) ** (1 / len(rates)))
    return float(rates.mean()) if measure == "avgacc" else float(np.trace(table) / table.sum())


def fitness(measure: float, rules: int, selected: int, penalty: float = 0.15) -> float:
    return measure - rules / (rules - selected + 1) * penalty


def matching_matrix(df: DataFrame, schema: FuzzySchema, sets: dict, rules: list[Rule], labels: int) -> DataFrame:
    """cls, m array<double>: the weighted matching of every rule, for rule selection. Worth persisting.

    Rows of an unknown class are left out, as they count in no confusion matrix.
    """
    width = max([len(r.items) for r in rules] or [1])
    places, weights = packed([list(r.items) for r in rules], schema, labels, width), np.array([r.weight for r in rules])
    rows = df.select(I.class_code(schema).alias("cls"), memberships(schema, sets).alias("mu")).where("cls >= 0")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            m = products(matrix(b.column(1)), places) * weights
            ends = np.arange(0, m.size + 1, m.shape[1] or 1)[: len(m) + 1] if m.shape[1] else np.zeros(len(m) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(m.reshape(-1)))], ["cls", "m"])

    return rows.mapInArrow(run, "cls int, m array<double>")


def population_confusion(matrix_rows: DataFrame, population: np.ndarray, rule_cls: list[int], classes: int, default: int, inference: str) -> np.ndarray:
    """chromosomes x real x pred counts of a whole generation, in one job.

    Each task counts for all chromosomes and hands on one small table; only those are summed.
    """
    box = matrix_rows.sparkSession.sparkContext.broadcast((population.astype(bool), np.array(rule_cls, np.int64)))

    def run(batches):
        import pyarrow as pa

        genes, cls = box.value
        total = np.zeros((len(genes), classes, classes), np.int64)
        for b in batches:
            real, m = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
            for k, own in enumerate(genes):
                pred, _ = choose(m[:, own], cls[own], classes, default, inference)
                np.add.at(total[k], (real, pred), 1)
        k, r, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (k, r, p)] + [pa.array(total[k, r, p])], ["chrom", "real", "pred", "n"])

    out = np.zeros((len(population), classes, classes), np.int64)
    for r in matrix_rows.mapInArrow(run, "chrom int, real int, pred int, n long").groupBy("chrom", "real", "pred").agg(F.sum("n").alias("n")).collect():
        out[r["chrom"], r["real"], r["pred"]] = r["n"]
    return out


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(n, list(r.items), len(r.items), r.cls, float(r.weight)) for n, r in enumerate(rules)], "rule int, itemset array<int>, len int, cls int, weight double")
