"""Rule bases on streams: rows are scored as they come, counts are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import itemsets as I
from quillon.plans.learner import FuzzyRuleModel


def score_stream(model: FuzzyRuleModel, stream: DataFrame, engine: str = "arrow") -> DataFrame:
    """Inference keeps no state, so it is the batch plan."""
    return model.transform(stream, engine)


def confusion_stream(model: FuzzyRuleModel, stream: DataFrame, time_col: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """real, pred, n so far (for complete or update mode); with time_col, by window, closed by the watermark."""
    rows = stream.withWatermark(time_col, late) if time_col else stream
    rows = model.transform(rows).withColumn("real", I.class_code(model.schema)).withColumn("pred", F.col("prediction"))
    keys = [F.window(time_col, window).alias("window")] if time_col else []
    return rows.groupBy(*keys, "real", "pred").agg(F.count("*").alias("n"))
