"""Files in and out: delimited tables under a header, settings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.params import Params, parse_config
from quillon.plans.schema import FuzzySchema, parse_header


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any file system that Spark knows."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_schema(spark: SparkSession, path: str, labels: int) -> FuzzySchema:
    return parse_header(read_text(spark, path), labels)


def read_config(spark: SparkSession, path: str) -> Params:
    return parse_config(read_text(spark, path))[0]


def read_table(spark: SparkSession, path: str, schema: FuzzySchema, on_missing: str = "error") -> DataFrame:
    """Comma-separated rows in the header's column order, typed once; values are trimmed.

    Reals that are no numbers raise, or their rows are dropped. Parquet is read as it is.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    order = schema.columns or (*[v.name for v in schema.variables], schema.label)
    raw = spark.read.csv(path, schema=T.StructType([T.StructField(c, T.StringType()) for c in order]), quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    real = {v.name for v in schema.reals}
    number = {c: F.col(f"`{c}`").try_cast("double") for c in real}
    if on_missing == "drop":
        return raw.withColumns(number).dropna(subset=list(real) or None)
    bad = lambda c: F.when(number[c].isNull(), F.raise_error(F.concat(F.lit(f"no number in {c}: "), F.coalesce(F.col(f"`{c}`"), F.lit("nothing")))).cast("double")).otherwise(number[c])
    return raw.withColumns({c: bad(c) for c in real})


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer parts than there are cores (a small file is one part); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_candidates(rows: DataFrame, path: str) -> None:
    """Candidate rules (rule, itemset, len, support, cls, conf, classes) as a folder of Parquet, to go on from later."""
    rows.write.mode("overwrite").parquet(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def confusion_lines(rows: DataFrame, classes: tuple[str, ...]) -> list[str]:
    """Tab-separated: a row for each real class, a column for each predicted one."""
    n = {(r["real"], r["pred"]): r["n"] for r in rows.collect()}
    return ["\t".join(str(n.get((i, j), 0)) for j in range(len(classes))) for i in range(len(classes))]


def accuracy_lines(values: dict[str, float]) -> list[str]:
    return [f"Accuracy: {values['accuracy']}", f"Geometric mean: {values['gm']}", f"Average accuracy: {values['avg_accuracy']}"]


def elapsed(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def histogram_lines(rows: DataFrame) -> list[str]:
    got = sorted((r["bin"], r["lo"], r["hi"], r["n"]) for r in rows.collect())
    return [" ".join(str(r[1]) for r in got) + (f" {got[-1][2]}" if got else ""), " ".join(str(r[3]) for r in got)]
