"""From a table to a rule base: the learner's stages, the estimator and the model."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.fuzzy import Triangle
from quillon.operators import itemsets as I
from quillon.operators import rules as R
from quillon.operators import scoring as S
from quillon.operators.scaling import Scaler, scale
from quillon.plans import chc
from quillon.plans.params import Params
from quillon.plans.schema import FuzzySchema, infer
from quillon.sources.files import spread


@dataclass
class Stages:
    """Each stage as a DataFrame, built when first asked for. `data` is scaled already.

    Only tables of itemsets and rules are kept in memory; they are small beside the data, which is
    read once for the cells and once for the matching.
    """

    data: DataFrame
    schema: FuzzySchema
    p: Params
    sets: dict[str, list[Triangle]] = None
    made: dict = field(default_factory=dict)

    def __post_init__(self):
        self.sets = self.sets or I.fuzzy_sets(self.schema, self.p.num_linguistic_labels)

    def _once(self, name: str, make, keep: bool = False):
        if name not in self.made:
            out = make()
            self.made[name] = out.persist() if keep else out
        return self.made[name]

    def cells(self) -> DataFrame:
        return self._once("cells", lambda: I.cells(self.data, self.schema, self.sets), keep=True)

    def itemsets(self) -> DataFrame:
        return self._once("itemsets", lambda: I.itemsets(self.cells(), self.schema, self.p), keep=True)

    def total(self) -> float:
        return self._once("total", lambda: _Value(I.total_coverage(self.cells(), self.schema, self.p))).value

    def candidates(self) -> DataFrame:
        return self._once("candidates", lambda: I.candidates(self.itemsets(), self.total()))

    def frequent(self) -> DataFrame:
        return self._once("frequent", lambda: I.frequent(self.candidates(), self.schema, self.p), keep=True)

    def thresholds(self) -> DataFrame:
        return I.thresholds(self.frequent(), self.p)

    def top(self) -> DataFrame:
        return self._once("top", lambda: I.top(self.frequent(), self.p), keep=True)

    def pruned(self) -> DataFrame:
        return self._once("pruned", lambda: R.numbered(I.pruned(self.top())), keep=True)

    def matching(self) -> DataFrame:
        def make():
            rules = [r["itemset"] for r in self.pruned().orderBy("rule").select("itemset").collect()]
            return R.class_matching(self.data, self.schema, self.sets, rules, self.p)

        return self._once("matching", make, keep=True)

    def examples(self) -> int:
        return self._once("examples", lambda: _Value(self.cells().agg(F.sum("n")).first()[0] or 0)).value

    def weighted(self) -> DataFrame:
        return R.weighted(self.matching(), self.pruned().select("rule", "itemset", "len", "classes"), self.examples(), self.p)

    def resolved(self) -> DataFrame:
        return R.fit_rules(R.resolved(self.weighted()), self.schema, self.p)

    def top_rules(self) -> DataFrame:
        return self._once("top_rules", lambda: R.top_rules(self.resolved(), self.schema, self.p), keep=True)

    def final(self) -> DataFrame:
        return self._once("final", lambda: R.numbered(I.pruned(self.top_rules().drop("rule"))), keep=True)

    def release(self) -> None:
        for x in self.made.values():
            if isinstance(x, DataFrame):
                x.unpersist()
        self.made.clear()


@dataclass
class _Value:
    value: object

    def persist(self):
        return self


@dataclass
class FuzzyRuleModel:
    schema: FuzzySchema  # of the original columns
    params: Params
    rules: list[S.Rule]
    sets: dict[str, list[Triangle]]
    scaler: Scaler | None = None
    times: dict[str, float] = field(default_factory=dict)
    evolution: list[dict] = field(default_factory=list)

    def scaled(self, df: DataFrame) -> DataFrame:
        return scale(df, self.schema, self.params.scale, self.scaler)[0]

    def transform(self, df: DataFrame, engine: str = "arrow") -> DataFrame:
        """df, its own columns as they were, with `prediction`, `predicted_class` and `score`. Works on streams."""
        real = {v.name for v in self.schema.reals}
        kept = df.withColumns({f"_own_{n}": F.col(f"`{n}`") for n in real}) if real else df
        got = S.predicted(self.scaled(kept), self.schema.scaled(self.params.scale), self.sets, self.rules, self.params.num_linguistic_labels, self.params.inference, engine)
        got = got.withColumn("predicted_class", F.get(F.array(*[F.lit(c) for c in self.schema.classes]), F.col("prediction")))
        return got.withColumns({n: F.col(f"`_own_{n}`") for n in real}).drop(*[f"_own_{n}" for n in real]) if real else got

    def confusion(self, df: DataFrame) -> DataFrame:
        return S.confusion(self.transform(df), self.schema)

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        return S.measures(self.confusion(df)).first().asDict()

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        return S.rules_table(spark, self.rules)

    def text(self, spark: SparkSession) -> list[str]:
        return [r["text"] for r in R.rule_text(self.rules_frame(spark), self.schema).orderBy("rule").collect()]

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder of Parquet and text, readable without this library, and the cut points with it."""
        settings = {"schema": json.loads(self.schema.to_json()), "params": asdict(self.params), "bounds": self.scaler.bounds if self.scaler else None, "tie": self.scaler.tie if self.scaler else None, "times": self.times}
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        cuts = [(n, i, q) for n, c in (self.scaler.cuts if self.scaler else {}).items() for i, q in enumerate(c)]
        spark.createDataFrame(cuts, "name string, idx int, q double").coalesce(1).write.mode("overwrite").parquet(f"{path}/quantiles")
        sets = [(n, j, s.left, s.mid, s.right) for n, own in self.sets.items() for j, s in enumerate(own)]
        spark.createDataFrame(sets, "name string, label int, l double, m double, r double").coalesce(1).write.mode("overwrite").parquet(f"{path}/fuzzy_sets")
        self.rules_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/rules")
        spark.createDataFrame([(t,) for t in self.text(spark)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rules_text")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FuzzyRuleModel:
        d = json.loads(spark.read.text(f"{path}/settings").first()[0])
        params = Params(**d["params"] | {"proportions_rule_lengths": tuple(d["params"]["proportions_rule_lengths"])})
        cuts: dict[str, list[float]] = {n: [] for n in d["bounds"] or {}}
        for r in spark.read.parquet(f"{path}/quantiles").orderBy("name", "idx").collect():
            cuts[r["name"]].append(r["q"])
        sets: dict[str, list[Triangle]] = {}
        for r in spark.read.parquet(f"{path}/fuzzy_sets").orderBy("name", "label").collect():
            sets.setdefault(r["name"], []).append(Triangle(r["l"], r["m"], r["r"]))
        rules = [S.Rule(tuple(r["itemset"]), r["cls"], r["weight"]) for r in spark.read.parquet(f"{path}/rules").orderBy("rule").collect()]
        scaler = Scaler(cuts, {n: tuple(b) for n, b in d["bounds"].items()}, d["tie"]) if d["bounds"] is not None else None
        return FuzzyRuleModel(FuzzySchema.from_json(json.dumps(d["schema"])), params, rules, sets, scaler, d["times"])


@dataclass
class FuzzyRuleClassifier:
    params: Params = field(default_factory=Params)

    def fit(self, df: DataFrame, schema: FuzzySchema | None = None, label: str | None = None, reals: list[str] | None = None, nominals: list[str] | None = None) -> FuzzyRuleModel:
        """Learn from df. Without a schema, bounds, values and class counts come from the data.

        With `evolutionary`, rule selection follows.
        """
        p, begun, df = self.params, time.time(), spread(df)
        schema = schema or infer(df, label, reals or [], nominals or [])
        data, scaled_schema, scaler = scale(df, schema, p.scale, bins=p.quantiles)
        stages = Stages(data, scaled_schema, p)
        times = {"scale": time.time() - begun}
        try:
            begun = time.time()
            stages.pruned().count()
            times["candidates"] = time.time() - begun
            begun = time.time()
            rules = [S.Rule(tuple(r["itemset"]), r["cls"], r["weight"]) for r in stages.final().orderBy("rule").collect()]
            times["weights"] = time.time() - begun
            log, begun = [], time.time()
            if p.evolutionary and rules:
                m = S.matching_matrix(data, scaled_schema, stages.sets, rules, p.num_linguistic_labels).persist()
                try:
                    found = chc.select_rules(m, rules, len(schema.classes), schema.default_class(), p)
                finally:
                    m.unpersist()
                rules, log = [r for r, g in zip(rules, found.best.genes) if g], found.log
            times["optimization"] = time.time() - begun
        finally:
            stages.release()
        return FuzzyRuleModel(schema, p, rules, stages.sets, scaler, times | {"total": sum(times.values())}, log)

    def tune(self, model: FuzzyRuleModel, df: DataFrame) -> FuzzyRuleModel:
        """Rule selection with lateral tuning of the fuzzy sets, on the rules of a model."""
        found, sets = chc.select_and_tune(model.scaled(df), model.schema.scaled(model.params.scale), model.sets, model.rules, self.params)
        return replace(model, rules=[r for r, g in zip(model.rules, found.best.genes) if g], sets=sets, evolution=found.log)
