"""Learning tables over the star schema: the inputs of the named queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import spread

TIER = "CASE WHEN l_quantity*(1-l_discount) > 30 AND l_extendedprice > 40000 THEN 'bulk' WHEN l_tax >= 0.05 THEN 'taxed' ELSE 'std' END"
VAL = "CASE WHEN o_totalprice > 350000 AND c_acctbal > 2000 THEN 'gold' WHEN o_totalprice > 150000 THEN 'silver' ELSE 'bronze' END"


@dataclass(frozen=True)
class Fixture:
    """reals and nominals in the order of the variables; sql gives the same rows in any SQL engine."""

    reals: tuple[str, ...]
    nominals: tuple[str, ...]
    label: str
    sql: str

    @property
    def names(self) -> tuple[str, ...]:
        return self.reals + self.nominals


F_TIER = Fixture(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"), "tier", f"SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, {TIER} AS tier FROM lineitem")
G_VAL = Fixture(("o_totalprice", "c_acctbal"), ("o_orderstatus", "o_orderpriority", "c_mktsegment"), "val", f"SELECT o_orderkey, o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment, {VAL} AS val FROM orders JOIN customer ON o_custkey = c_custkey")


WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
#: Read from documents and labels; the SQL form is for the twin.
C_QUALITY = Fixture(("n_chars", "n_words", "n_uniq"), ("lang",), "quality", f"SELECT CAST(n_chars AS DOUBLE) AS n_chars, CAST(len({WORDS}) AS DOUBLE) AS n_words, CAST(len(list_distinct({WORDS})) AS DOUBLE) AS n_uniq, lang, CAST(quality AS VARCHAR) AS quality FROM documents JOIN labels USING (doc_id)")


def tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spread(rows.select(*F_TIER.names, F.expr(TIER).alias("tier")))


def value(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return spread(rows.select("o_orderkey", *G_VAL.names, F.expr(VAL).alias("val")))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels: sizes and language against quality."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = docs.join(labels, "doc_id").withColumn("_w", words)
    return rows.select(F.col("n_chars").cast("double").alias("n_chars"), F.size("_w").cast("double").alias("n_words"), F.size(F.array_distinct("_w")).cast("double").alias("n_uniq"), "lang", F.col("quality").cast("string").alias("quality"))
