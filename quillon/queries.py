"""Named queries: one or more for each operator, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.functions import fuzzy as Z
from quillon.operators import itemsets as I
from quillon.operators import rules as R
from quillon.operators import scaling as C
from quillon.operators import scoring as S
from quillon.operators import tuning as T
from quillon.plans import chc
from quillon.plans.learner import FuzzyRuleClassifier, FuzzyRuleModel, Stages
from quillon.plans.params import Params, parse_config, to_config
from quillon.plans.schema import FuzzySchema, infer, parse_header
from quillon.sources import files
from quillon.sources.files import spread

LABELS, BINS = 5, 1000
P = Params(min_crisp_confidence=0.7, min_fuzzy_confidence=0.6, proportion_initial_rules_evolutionary=2, evolutionary=False)
PLAIN = Params(min_crisp_confidence=0.7, min_fuzzy_confidence=0.6, proportion_initial_rules_evolutionary=2, evolutionary=False, cost_sensitive=False)
CF = Params(min_crisp_confidence=0.7, min_fuzzy_confidence=0.6, proportion_initial_rules_evolutionary=2, evolutionary=False, weight_method="cf")

#: A fixed rule table for scoring queries: (variable, label) pairs on G, class, weight.
RULES = (
    (((0, 4), (1, 3)), 1, 0.9), (((0, 4), (1, 4)), 1, 0.85), (((0, 2),), 2, 0.6), (((0, 3),), 2, 0.7), (((0, 0),), 0, 0.8), (((0, 1), (2, 0)), 0, 0.55), (((0, 1), (4, 2)), 0, 0.5), (((0, 4), (1, 0)), 2, 0.4),
)
POPULATION = ((1, 1, 1, 1, 1, 1, 1, 1), (1, 0, 1, 1, 1, 0, 0, 0), (0, 1, 0, 1, 1, 1, 0, 1), (0, 0, 1, 0, 1, 0, 0, 0), (1, 1, 0, 0, 0, 0, 1, 1))


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a session with a local master and without it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{top.rstrip('/')}/quillon/{label}-{uuid.uuid4().hex}"


def rounded(c, digits: int):
    """Half away from zero after c * 10**digits, in doubles, as the SQL twins round.

    F.round takes a double's shortest decimal form instead, so the two part on ties such as 0.0629005.
    """
    unit = 10.0**digits
    if isinstance(c, float):
        return math.copysign(math.floor(abs(c) * unit) + (abs(c) * unit % 1 >= 0.5), c) / unit
    return F.round((F.col(c) if isinstance(c, str) else c) * unit) / F.lit(unit)


def r6(c):
    return rounded(c, 6)


def prepared(spark: SparkSession, sf_dir: str, fixture: X.Fixture, rows, p: Params = P) -> Stages:
    """The fixture on the uniform scale, with its stages."""
    df = rows(spark, sf_dir)
    schema = infer(df, fixture.label, list(fixture.reals), list(fixture.nominals))
    schema = FuzzySchema(tuple(sorted(schema.variables, key=lambda v: fixture.names.index(v.name))), schema.label, schema.classes, schema.counts, schema.columns)
    data, scaled, _ = C.scale(df, schema, "uniform", bins=BINS)
    return Stages(data, scaled, p)


def stages_f(spark, sf_dir, p=P) -> Stages:
    return prepared(spark, sf_dir, X.F_TIER, X.tier, p)


def stages_g(spark, sf_dir, p=P) -> Stages:
    return prepared(spark, sf_dir, X.G_VAL, X.value, p)


def shown(df: DataFrame, st: Stages, *more) -> DataFrame:
    """The itemset as text and its length before the other columns."""
    return df.select(I.item_text(F.col("itemset"), st.schema).alias("items"), F.col("len").cast("int").alias("len"), *more)


def class_name(st: Stages, c="cls"):
    return F.get(F.array(*[F.lit(x) for x in st.schema.classes]), F.col(c)).alias("class")


# sources, schema, scalar transforms


def class_cost(spark, sf_dir):
    st = infer(X.tier(spark, sf_dir), "tier", list(X.F_TIER.reals), list(X.F_TIER.nominals))
    rows = [(c, n, float(cost), float(f), int(i == st.default_class())) for i, (c, n, cost, f) in enumerate(zip(st.classes, st.counts, st.costs(), st.frequencies()))]
    got = spark.createDataFrame(rows, "class string, n long, cost double, share double, is_default int")
    return got.select("class", "n", r6("cost").alias("cost"), r6("share").alias("share"), "is_default")


def quantile_cuts(spark, sf_dir):
    names = ["l_extendedprice", "l_quantity"]
    return C.quantile_cuts(spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*names)), names, BINS)


def pit_transform(spark, sf_dir):
    names = list(X.F_TIER.reals)
    df = X.tier(spark, sf_dir)
    schema = infer(df, "tier", names, list(X.F_TIER.nominals))
    out = C.Scaler.fit(df, schema, BINS).transform(df)
    return C.unpivot(out, names).groupBy("var", r6("value").alias("value")).agg(F.count("*").alias("n"))


def pit_inverse(spark, sf_dir):
    df = X.tier(spark, sf_dir)
    schema = infer(df, "tier", ["l_extendedprice"], [])
    scaler = C.Scaler.fit(df.select("l_extendedprice", "tier"), schema, BINS)
    grid = spark.range(0, 2001).select((F.col("id") / 2000.0).alias("u"))
    return grid.select("u", rounded(scaler.inverse(F.col("u"), "l_extendedprice"), 4).alias("value"))


def log_scaled(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lo, hi = rows.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    b = Z.log_bounds(lo, hi)
    return rows.select("c_custkey", r6(Z.log_scale(F.col("c_acctbal"), lo)).alias("logged"), F.lit(r6(b[0])).alias("lo"), F.lit(r6(b[1])).alias("hi"))


def nominal_codes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    values = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")  # one value is left out: it gets -1
    code = Z.nominal_code(F.col("o_orderpriority"), values)
    share = Z.nominal_share(F.col("code"), values)
    back = F.when(F.col("code") >= 0, Z.nominal_from_share(share, values))
    return rows.select("o_orderpriority", code.alias("code")).groupBy("o_orderpriority", "code").agg(F.count("*").alias("n")).select("o_orderpriority", "code", "n", share.alias("share"), back.alias("back"), Z.nominal_value(F.when(F.col("code") >= 0, F.col("code")), values).alias("value"))


def crisp_labels(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    cols = I.label_columns(st.schema, st.sets)
    names = [v.name for v in st.schema.variables]
    return st.data.select(*[c.alias(n) for n, c in zip(names, cols)]).groupBy(*names).agg(F.count("*").alias("n"))


def membership_long(spark, sf_dir):
    """Sums of membership by variable and label."""
    st = stages_f(spark, sf_dir)
    at = R.slots(st.schema, LABELS)
    mu = st.data.select(R.memberships(st.schema, st.sets).alias("mu"))
    cells = F.array(*[F.struct(F.lit(i // I.STEP).alias("var"), F.lit(i % I.STEP).alias("label"), F.get("mu", k).alias("m")) for i, k in at.items()])
    return mu.select(F.inline(cells)).groupBy("var", "label").agg(rounded(F.sum("m"), 3).alias("total"), F.sum((F.col("m") > 0).cast("long")).alias("n"))


# itemsets


def crisp_cells(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    names = [v.name for v in st.schema.variables]
    return st.cells().select(*[F.get("labels", i).alias(n) for i, n in enumerate(names)], class_name(st), "n")


def candidate_itemsets(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return shown(st.itemsets(), st, class_name(st), r6("cov").alias("cov"))


def _candidates(df, st):
    return shown(df, st, class_name(st), r6("support").alias("support"), r6("conf").alias("conf"))


def frequent_itemsets(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return _candidates(st.frequent(), st)


def confidence_thresholds(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return st.thresholds().select(class_name(st), F.col("len").cast("int").alias("len"), r6("threshold").alias("threshold"))


def confidence_thresholds_plain(spark, sf_dir):
    st = stages_g(spark, sf_dir, PLAIN)
    return st.thresholds().select(F.col("len").cast("int").alias("len"), r6("threshold").alias("threshold"))


def top_itemsets(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return _candidates(st.top(), st)


def pruned_itemsets(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return _candidates(st.pruned(), st)


# rules


def rule_class_matching(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return shown(st.matching().join(F.broadcast(st.pruned().select("rule", "itemset", "len")), "rule"), st, class_name(st), rounded("m", 2).alias("m"))


def _weights(st):
    return shown(st.weighted(), st, class_name(st), rounded("weight", 5).alias("weight"), rounded("support", 5).alias("support"), rounded("conf", 5).alias("conf"))


def rule_weights_pcf(spark, sf_dir):
    return _weights(stages_f(spark, sf_dir))


def rule_weights_cf(spark, sf_dir):
    return _weights(stages_f(spark, sf_dir, CF))


def _rules(df, st):
    return shown(df, st, class_name(st), rounded("weight", 5).alias("weight"), rounded("support", 5).alias("support"), rounded("conf", 5).alias("conf"))


def resolved_rules(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return _rules(st.resolved(), st)


def topk_rules(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return _rules(st.top_rules(), st)


def topk_rules_plain(spark, sf_dir):
    st = stages_f(spark, sf_dir, PLAIN)
    return _rules(st.top_rules(), st)


def final_rules(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return _rules(st.final(), st)


def rule_text(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return R.rule_text(st.final(), st.schema).select("text")


def rulebase_stats(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    got = R.statistics(st.final(), st.schema)
    return got.select("class", "n_rules", r6("mean_len").alias("mean_len"), rounded("mean_weight", 5).alias("mean_weight"))


# scoring, on fixed rules


def fixed_rules() -> list[S.Rule]:
    return [S.Rule(tuple(v * I.STEP + j for v, j in items), c, w) for items, c, w in RULES]


def _classified(spark, sf_dir, inference):
    st = stages_g(spark, sf_dir)
    return S.predicted(st.data, st.schema, st.sets, fixed_rules(), LABELS, inference), st


def _scored(spark, sf_dir, inference):
    got, st = _classified(spark, sf_dir, inference)
    return got.select("o_orderkey", class_name(st, "prediction"), rounded("score", 5).alias("score"))


def classify_winning(spark, sf_dir):
    return _scored(spark, sf_dir, "winning_rule")


def classify_additive(spark, sf_dir):
    return _scored(spark, sf_dir, "additive")


def classify_selected(spark, sf_dir):
    """Winning rule among the rules of the second chromosome."""
    st = stages_g(spark, sf_dir)
    rules = [r for r, on in zip(fixed_rules(), POPULATION[1]) if on]
    got = S.predicted(st.data, st.schema, st.sets, rules, LABELS, engine="sql")
    return got.select("o_orderkey", class_name(st, "prediction"), rounded("score", 5).alias("score"))


def confusion_matrix(spark, sf_dir):
    got, st = _classified(spark, sf_dir, "winning_rule")
    names = F.array(*[F.lit(x) for x in st.schema.classes])
    return S.confusion(got, st.schema).select(F.get(names, "real").alias("real"), F.get(names, "pred").alias("pred"), "n")


def accuracy_stats(spark, sf_dir):
    got, st = _classified(spark, sf_dir, "winning_rule")
    return S.measures(S.confusion(got, st.schema)).select(*[r6(c).alias(c) for c in ("accuracy", "gm", "avg_accuracy")])


def matching_matrix(spark, sf_dir):
    """Sums of the weighted matching of every rule, by class."""
    st = stages_g(spark, sf_dir)
    m = S.matching_matrix(st.data, st.schema, st.sets, fixed_rules(), LABELS)
    return m.select("cls", F.posexplode("m").alias("rule", "x")).groupBy(class_name(st), F.col("rule").cast("int").alias("rule")).agg(rounded(F.sum("x"), 3).alias("total"))


def chromosome_fitness(spark, sf_dir):
    st = stages_g(spark, sf_dir)
    m = S.matching_matrix(st.data, st.schema, st.sets, fixed_rules(), LABELS)
    tables = S.population_confusion(m, np.array(POPULATION, bool), [c for _, c, _ in RULES], len(st.schema.classes), st.schema.default_class(), "winning_rule")
    rows = [(k, int(sum(genes)), *(r6(S.fitness(S.measures_of(t, name), len(RULES), sum(genes))) for name in ("accuracy", "gm", "avgacc"))) for k, (genes, t) in enumerate(zip(POPULATION, tables))]
    return spark.createDataFrame(rows, "chrom int, k int, by_accuracy double, by_gm double, by_avg double")


def chc_select(spark, sf_dir):
    """Rule selection by CHC on the learned rules of G, with a short budget."""
    p = Params(min_crisp_confidence=0.7, min_fuzzy_confidence=0.6, proportion_initial_rules_evolutionary=2, fitness="geometric_mean", max_evaluations=300, population_size=30)
    df = X.value(spark, sf_dir)
    schema = infer(df, "val", list(X.G_VAL.reals), list(X.G_VAL.nominals))
    model = FuzzyRuleClassifier(p).fit(df, schema)
    return R.rule_text(model.rules_frame(spark), schema)


def chc_tune(spark, sf_dir):
    """Selection with lateral tuning: the log of a short run on fixed rules."""
    st = stages_g(spark, sf_dir)
    p = Params(max_evaluations=60, population_size=12, fitness="gm")
    found, _ = chc.select_and_tune(st.data, st.schema, st.sets, fixed_rules(), p)
    return spark.createDataFrame([(x["generation"], x["evaluations"], x["best"], x["rules"]) for x in found.log], "generation int, evaluations int, best double, rules int")


# tuning and the rest


def fuzzyset_stats(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    return T.set_statistics(st.data, st.schema, st.sets).select("var", "label", rounded("total", 3).alias("total"), "n")


def recentred_sets(spark, sf_dir):
    st = stages_f(spark, sf_dir)
    got = T.recentred(T.set_statistics(st.data, st.schema, st.sets), st.schema, st.sets)
    return got.select("var", "label", *[rounded(c, 5).alias(c) for c in ("l", "m", "r")])


def translated_sets(spark, sf_dir):
    """The uniform sets of the price, on the price's own scale."""
    df = X.tier(spark, sf_dir)
    schema = infer(df, "tier", ["l_extendedprice"], [])
    scaler = C.Scaler.fit(df.select("l_extendedprice", "tier"), schema, BINS)
    sets = scaler.translate(Z.partition(0.0, 1.0, LABELS), "l_extendedprice")
    return spark.createDataFrame([(j, *(rounded(float(x), 4) for x in (s.left, s.mid, s.right))) for j, s in enumerate(sets)], "label int, l double, m double, r double")


def lateral_shift(spark, sf_dir):
    genes = (0.5, 0.25, 0.75, 0.1, 0.9)
    sets = Z.displaced(Z.partition(0.0, 1.0, LABELS), list(genes))
    return spark.createDataFrame([(j, *(r6(float(x)) for x in (s.left, s.mid, s.right))) for j, s in enumerate(sets)], "label int, l double, m double, r double")


def gray_hamming(spark, sf_dir):
    rows = spark.range(0, 500).select((F.col("id") / 500.0).alias("a"), ((F.col("id") * 7 % 500) / 500.0).alias("b"))
    return rows.select("a", "b", Z.gray_distance(F.col("a"), F.col("b"), 30).alias("d"))


def pcblx_bounds(spark, sf_dir):
    rows = spark.range(0, 500).select((F.col("id") / 500.0).alias("a"), ((F.col("id") * 7 % 500) / 500.0).alias("b"))
    lo, hi = Z.blend_bounds(F.col("a"), F.col("b"), 1.0)
    return rows.select("a", "b", r6(lo).alias("lo"), r6(hi).alias("hi"))


def histogram10(spark, sf_dir):
    return T.histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice").select("bin", rounded("lo", 4).alias("lo"), rounded("hi", 4).alias("hi"), "n")


def header_roundtrip(spark, sf_dir):
    df = X.tier(spark, sf_dir)
    schema = infer(df, "tier", list(X.F_TIER.reals), list(X.F_TIER.nominals))
    again = parse_header(schema.to_header(), LABELS)
    return spark.createDataFrame([(v.name, v.kind, v.lo, v.hi, ",".join(v.values)) for v in again.variables], "name string, kind string, lo double, hi double, vals string")


def config_roundtrip(spark, sf_dir):
    again, unknown = parse_config(to_config(P) + "unknown = 1\n")
    return spark.createDataFrame([(line.split(" = ")[0], line.split(" = ")[1]) for line in to_config(again).splitlines()] + [("not understood", u) for u in unknown], "name string, value string")


def itemset_ranking(spark, sf_dir):
    """The flagship on documents: all itemsets of size and language labels by support and confidence."""
    df = X.quality(spark, sf_dir)
    schema = infer(df, "quality", ["n_chars", "n_words", "n_uniq"], ["lang"])
    data, scaled, _ = C.scale(df, schema, "uniform", bins=BINS)
    st = Stages(data, scaled, P)
    return _candidates(st.candidates(), st).orderBy(F.desc("support"), "items")


def rule_numbers(spark, sf_dir):
    """The numbers of the candidate rules: the order in which ties are decided."""
    st = stages_f(spark, sf_dir)
    return shown(st.pruned(), st, "rule")


def candidates_checkpoint(spark, sf_dir):
    """Candidate rules written to a folder and read again."""
    st, path = stages_f(spark, sf_dir), work_folder(spark, "candidates")
    files.write_candidates(st.pruned(), path)
    return _candidates(files.read_candidates(spark, path), st)


def delimited_rows(spark, sf_dir):
    """Rows and header written as comma-separated text and read again, typed: sums by label and nominal value."""
    df, path = X.value(spark, sf_dir).select(*X.G_VAL.names, "val"), work_folder(spark, "delimited")
    schema = infer(df, "val", list(X.G_VAL.reals), list(X.G_VAL.nominals))
    df.select(*schema.columns).write.mode("overwrite").csv(f"{path}/rows", ignoreLeadingWhiteSpace=False)
    files.write_lines(spark, f"{path}/header", schema.to_header().splitlines())
    again = files.read_table(spark, f"{path}/rows", files.read_schema(spark, f"{path}/header", LABELS))
    return again.groupBy("val", "o_orderstatus", "c_mktsegment").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("price"), rounded(F.min("c_acctbal"), 2).alias("least"))


def training_cuts(spark, sf_dir):
    """Cut points of the training orders, applied to the others."""
    df, names = X.value(spark, sf_dir), list(X.G_VAL.reals)
    train = df.where("o_orderkey % 4 <> 0")
    scaler = C.Scaler.fit(train, infer(train, "val", names, list(X.G_VAL.nominals)), BINS)
    return scaler.transform(df.where("o_orderkey % 4 = 0")).select("o_orderkey", *[r6(n).alias(n) for n in names])


def fixed_model(spark, sf_dir) -> tuple[FuzzyRuleModel, DataFrame]:
    """A model of the fixed rules, and the rows that it was fitted to."""
    df = X.value(spark, sf_dir)
    schema = infer(df, "val", list(X.G_VAL.reals), list(X.G_VAL.nominals))
    schema = FuzzySchema(tuple(sorted(schema.variables, key=lambda v: X.G_VAL.names.index(v.name))), schema.label, schema.classes, schema.counts, schema.columns)
    scaler = C.Scaler.fit(df, schema, BINS)
    return FuzzyRuleModel(schema, P, fixed_rules(), I.fuzzy_sets(schema.scaled("uniform"), LABELS), scaler), df


def saved_model_classify(spark, sf_dir):
    """A model written to a folder and read again classifies the rows of a table."""
    model, df = fixed_model(spark, sf_dir)
    path = work_folder(spark, "model")
    model.save(spark, path)
    got = FuzzyRuleModel.load(spark, path).transform(df)
    return got.select("o_orderkey", F.col("predicted_class").alias("class"), rounded("score", 5).alias("score"))


def confusion_report(spark, sf_dir):
    """The lines of the confusion report, written and read again."""
    got, st = _classified(spark, sf_dir, "winning_rule")
    path = work_folder(spark, "report")
    files.write_lines(spark, path, files.confusion_lines(S.confusion(got, st.schema), st.schema.classes))
    return spark.read.text(path).select(F.col("value").alias("line"))


def chc_best(spark, sf_dir):
    """The fitness that CHC reaches on the eight fixed rules: that of the best of all their subsets."""
    st = stages_g(spark, sf_dir)
    m = S.matching_matrix(st.data, st.schema, st.sets, fixed_rules(), LABELS).persist()
    try:
        found = chc.select_rules(m, fixed_rules(), len(st.schema.classes), st.schema.default_class(), Params(fitness="gm", max_evaluations=600, population_size=40))
    finally:
        m.unpersist()
    return spark.createDataFrame([(r6(float(found.best.value)),)], "best double")


_ALL = (
    class_cost, quantile_cuts, pit_transform, pit_inverse, log_scaled, nominal_codes, crisp_labels, membership_long, crisp_cells, candidate_itemsets, frequent_itemsets, confidence_thresholds, confidence_thresholds_plain, top_itemsets, pruned_itemsets,
    rule_class_matching, rule_weights_pcf, rule_weights_cf, resolved_rules, topk_rules, topk_rules_plain, final_rules, rule_text, rulebase_stats, classify_winning, classify_additive, classify_selected, confusion_matrix, accuracy_stats, matching_matrix,
    chromosome_fitness, chc_select, chc_tune, fuzzyset_stats, recentred_sets, translated_sets, lateral_shift, gray_hamming, pcblx_bounds, histogram10, header_roundtrip, config_roundtrip, itemset_ranking,
    rule_numbers, candidates_checkpoint, delimited_rows, training_cuts, saved_model_classify, confusion_report, chc_best,
)
QUERIES = {f.__name__: f for f in _ALL}
