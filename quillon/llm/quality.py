"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule sets a feature against a cutoff from a fixed ladder. On labelled documents, stratum by
stratum, the ladder is climbed from the mildest cutoff: a cutoff is taken as long as the exact binomial
test rejects "at least `risk` of the good documents are lost", each rule having an equal part of the
risk (so all rules together keep to it) and each (stratum, rule) an equal part of the error rate
(Bonferroni; within a ladder the fixed order needs no more). Strata with too few labels keep all.

Base counts follow the contract; they need no labels.

Defined cases: a null text has no words and fails the base; features of a text without words are 0;
documents labelled more than once count as good only if every label says so; a null stratum is a
stratum; rows repeat as they are; an empty table gives no rows; nulls among labels are skipped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, cut, id_text
from quillon.llm.secrets import let

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rules: feature, then its ladder, mildest first. A document is lost at a value of at least the cutoff.
LADDERS = {
    "symbol_share": (0.8, 0.6, 0.45, 0.3, 0.2, 0.12, 0.07),
    "dup_line_share": (0.9, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.9, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12),
    "upper_share": (0.95, 0.85, 0.7, 0.55, 0.4, 0.3, 0.2),
    "long_words": (24.0, 18.0, 15.0, 12.5, 11.0, 10.0, 9.0),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW that stand in the text twice or more."""
    n = F.size(words)

    def covered(windows):
        pairs = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        again = lambda s: F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)))), lambda x: x["i"])
        steps = lambda at: F.aggregate(F.zip_with(F.slice(at, F.lit(2), F.size(at)), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, d: s + d)
        return let(let(pairs, again), lambda s: let(F.array_sort(s), steps))

    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(WINDOW)), " "))
    return F.when(n >= WINDOW, let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))).otherwise(F.lit(0))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row a document: stratum, the base counts, base_failed and the rules' features."""
    rows = id_text(docs, id_col, text_col, stratum=docs[stratum_col].cast("string")).withColumn("text", F.coalesce("text", F.lit("")))
    spaces = " \t\n\x0b\x0c\r"
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    rows = rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", spaces, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("word_chars", "n_words").alias("long_words"),
    )


def log_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, brought back by the recurrence: 12 digits and more."""
    z = n + 8.0
    series = (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - sum((F.log(n + float(i)) for i in range(2, 9)), F.log(n + 1.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) where each has chance p: summed from the term at k down, until terms vanish.

    Above the mean the tail is over 0.3 or so, no test there can pass, and 1 is returned.
    """
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a, i):
        j = k - i.cast("double")  # the term at j from that at j + 1
        term = a["term"] * (j + 1) / (n - j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    rest = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), zero, step, lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first) * rest))


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """stratum, and for each rule the chosen cutoff (null: none). One row a stratum that has good labels."""
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    good = rows.where(~F.col("base_failed")).join(marks.where("good = 1").select("doc_id"), "doc_id", "left_semi")
    lost = [F.sum((F.col(f) >= c).cast("long")).alias(f"{f}_{i}") for f, ladder in LADDERS.items() for i, c in enumerate(ladder)]
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *lost)
    tests = counts.join(F.broadcast(counts.agg(F.count("*").alias("strata"))))  # one row
    level = error / (F.col("strata") * len(LADDERS))
    picks = []
    for f, ladder in LADDERS.items():
        passed = F.array(*[binomial_tail(F.col(f"{f}_{i}").cast("double"), F.col("n").cast("double"), risk / len(LADDERS)) <= level for i in range(len(ladder))])
        first_no = F.array_position(passed, False)  # 1-based; 0: all passed
        steps = F.when(first_no == 0, len(ladder)).otherwise(first_no - 1).cast("int")
        picks.append(F.get(F.array(*[F.lit(c) for c in ladder]), steps - 1).alias(f"cut_{f}"))
    return tests.select("stratum", *picks)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.05, error: float = 0.05, most_strata: int = 10_000, salts: int = 16) -> DataFrame:
    """The contract's columns and the features for every row of docs."""
    rows = cut(features(docs, id_col, text_col, stratum_col), "quality-features")
    cuts = cut(cutoffs(rows, labels, "doc_id", label_col, risk, error), "quality-cutoffs")
    if cuts.count() <= most_strata:
        same = rows.alias("r").join(F.broadcast(cuts.alias("c")), F.expr("r.stratum <=> c.stratum"), "left")
    else:  # too many to send: hot strata are split
        many = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).alias("r").join(many.alias("c"), F.expr("r.salt = c.salt and r.stratum <=> c.stratum"), "left")
    fails = F.lit(False)
    for f in LADDERS:
        fails = fails | F.coalesce(F.col(f"r.{f}") >= F.col(f"c.cut_{f}"), F.lit(False))
    return same.select("r.doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.n_repeat_words", "r.base_failed", (~(F.col("r.base_failed") | fails)).alias("kept"))
