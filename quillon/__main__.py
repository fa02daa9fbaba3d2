"""python -m quillon fit|evaluate|transform|run: see --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillon.operators import rules as R
from quillon.plans.learner import FuzzyRuleClassifier, FuzzyRuleModel
from quillon.sources import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillon")
    parser.add_argument("mode", choices=("fit", "evaluate", "transform", "run"), help="run: fit, then evaluate")
    parser.add_argument("--config")
    parser.add_argument("--header")
    parser.add_argument("--train")
    parser.add_argument("--test")
    parser.add_argument("--model", required=True)
    parser.add_argument("--output")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    if a.mode in ("fit", "run"):
        params = files.read_config(spark, a.config)
        schema = files.read_schema(spark, a.header, params.num_linguistic_labels)
        model = FuzzyRuleClassifier(params).fit(files.read_table(spark, a.train, schema), schema)
        model.save(spark, a.model)
        stats = R.statistics(model.rules_frame(spark), schema).orderBy("cls").collect()
        files.write_lines(spark, f"{a.model}/stats", [str(r.asDict()) for r in stats])
        files.write_lines(spark, f"{a.model}/evolution", [str(x) for x in model.evolution])
        files.write_lines(spark, f"{a.model}/times", [f"{k}: {files.elapsed(v)}" for k, v in model.times.items()])
    model = FuzzyRuleModel.load(spark, a.model)
    if a.mode in ("evaluate", "run"):
        found = model.confusion(files.read_table(spark, a.test, model.schema)).persist()
        from quillon.operators.scoring import measures

        out = a.output or f"{a.model}/test"
        files.write_lines(spark, f"{out}/confusion", files.confusion_lines(found, model.schema.classes))
        files.write_lines(spark, f"{out}/accuracy", files.accuracy_lines(measures(found).first().asDict()))
        found.unpersist()
    if a.mode == "transform":
        model.transform(files.read_table(spark, a.test, model.schema)).write.parquet(a.output)


if __name__ == "__main__":
    main()
