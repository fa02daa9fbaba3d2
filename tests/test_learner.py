import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import itemsets as I
from quillon.operators import rules as R
from quillon.operators import scoring as S
from quillon.plans import chc
from quillon.plans.learner import FuzzyRuleClassifier, FuzzyRuleModel, Stages
from quillon.plans.params import Params
from quillon.plans.schema import infer
from quillon.sources import files
from quillon.streaming.score import confusion_stream

P = Params(min_crisp_confidence=0.7, min_fuzzy_confidence=0.6, evolutionary=False)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x, y, n = rng.random(200), rng.random(200), rng.choice(["p", "q"], 200)
    rows = [(float(a), float(b), str(c), "hi" if a > 0.6 else "mid" if b > 0.5 or c == "p" else "lo") for a, b, c in zip(x, y, n)]
    df = spark.createDataFrame(rows, "x double, y double, n string, cls string").persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def model(data):
    return FuzzyRuleClassifier(P).fit(data, label="cls", reals=["x", "y"], nominals=["n"])


def test_matching_engines_agree_with_brute_force(data):
    schema = infer(data, "cls", ["x", "y"], ["n"])
    sets = I.fuzzy_sets(schema, 5)
    rules = [[1], [I.STEP + 3], [2, I.STEP + 1], [4, I.STEP + 2, 2 * I.STEP]]
    got = [{(r["rule"], r["cls"]): r["m"] for r in R.class_matching(data, schema, sets, rules, P, e).collect()} for e in ("arrow", "sql")]
    want, costs = {}, schema.costs()
    for row in data.collect():
        c = schema.classes.index(row["cls"])
        for k, items in enumerate(rules):
            m = 1.0
            for i in items:
                v = schema.variables[i // I.STEP]
                m *= sets[v.name][i % I.STEP](row[v.name]) if v.is_real else float(row[v.name] == v.values[i % I.STEP])
            if m:
                want[k, c] = want.get((k, c), 0) + m * costs[c]
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want)


def test_itemsets_against_brute_force(data):
    schema = infer(data, "cls", ["x", "y"], ["n"])
    st = Stages(data, schema, P)
    got = {(tuple(r["itemset"]), r["cls"]): r["cov"] for r in st.itemsets().collect()}
    want, costs = {}, schema.costs()
    for r in I.labelled(data, schema, st.sets).collect():
        for k in (1, 2, 3):
            for c in itertools.combinations(range(3), k):
                key = tuple(i * I.STEP + r["labels"][i] for i in c), r["cls"]
                want[key] = want.get(key, 0) + costs[r["cls"]]
    assert got == pytest.approx(want)
    # coverage never grows with an item, and each variable's items cover all
    assert all(v <= got[key[0][:1], key[1]] + 1e-9 for key, v in got.items())
    assert sum(v for (s, _), v in got.items() if len(s) == 1 and s[0] < I.STEP) == pytest.approx(st.total())
    once = I.pruned(st.top()).persist()
    assert I.pruned(once).count() == once.count()


def test_learns_and_scores_alike_with_both_engines(spark, data, model):
    assert model.evaluate(data)["accuracy"] > 0.7
    for inference in ("winning_rule", "additive"):
        m = FuzzyRuleModel(model.schema, Params(min_crisp_confidence=0.7, min_fuzzy_confidence=0.6, inference=inference), model.rules, model.sets, model.scaler)
        a, b = (m.transform(data, e).select("x", "prediction", F.round("score", 9)).collect() for e in ("arrow", "sql"))
        assert a == b
    assert m.transform(data).select(*data.columns).collect() == data.collect()


def test_save_and_load(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = FuzzyRuleModel.load(spark, str(tmp_path / "m"))
    assert (again.rules, again.sets, again.scaler, again.schema, again.params) == (model.rules, model.sets, model.scaler, model.schema, model.params)


def test_no_rules_gives_the_default_class(data, model):
    empty = FuzzyRuleModel(model.schema, P, [], model.sets, model.scaler)
    for e in ("arrow", "sql"):
        assert {r["prediction"] for r in empty.transform(data, e).select("prediction").collect()} == {model.schema.default_class()}


def test_nulls_and_unknown_values(spark, data, model):
    rows = spark.createDataFrame([(None, 0.5, "p", "hi"), (0.1, None, None, "lo"), (0.2, 0.2, "never", "never")], "x double, y double, n string, cls string")
    assert model.transform(rows).count() == 3
    assert sum(r["n"] for r in model.confusion(rows).collect()) == 2  # rows of a known class
    assert I.labelled(rows, model.schema.scaled("uniform"), model.sets).count() == 2


def test_selection_is_repeatable_and_never_worse(spark, data, model):
    p = Params(max_evaluations=200, population_size=10, fitness="gm")
    m = S.matching_matrix(model.scaled(data), model.schema.scaled("uniform"), model.sets, model.rules, 5).persist()
    runs = [chc.select_rules(m, model.rules, 3, 0, p) for _ in range(2)]
    assert (runs[0].best.genes == runs[1].best.genes).all()
    best = [x["best"] for x in runs[0].log]
    assert best == sorted(best)
    tuned = FuzzyRuleClassifier(Params(max_evaluations=40, population_size=7)).tune(model, data)
    assert tuned.transform(data).count() == 200


def test_genetic_operators():
    rng = np.random.default_rng(0)
    a, b = rng.random(50) < 0.5, rng.random(50) < 0.5
    x, y = chc.half_uniform(a, b, rng)
    assert ((x == a) | (x == b)).all() and (x[a == b] == a[a == b]).all()
    assert (x != a).sum() == (y != b).sum() == -(-int((a != b).sum()) // 2)
    s, t = rng.random(20), rng.random(20)
    u, v = chc.blended(s, t, 1.0, rng)
    assert (np.abs(u - s) <= np.abs(s - t) + 1e-12).all() and ((v >= 0) & (v <= 1)).all()


def test_stream(spark, data, model, tmp_path):
    data.select("x", "y", "n", "cls").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double, n string, cls string").parquet(str(tmp_path / "in"))
    q = confusion_stream(model, stream).writeStream.outputMode("complete").format("memory").queryName("conf").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["real"], r["pred"], r["n"]) for r in model.confusion(data).collect() if r["n"]}
    assert {tuple(r) for r in spark.table("conf").select("real", "pred", "n").collect()} == want


def test_command_line(spark, data, model, tmp_path):
    from quillon.__main__ import main

    data.coalesce(1).write.csv(str(tmp_path / "d"))
    (tmp_path / "h").write_text(model.schema.to_header())
    (tmp_path / "c").write_text("max_attributes = 3\nmin_crisp_confidence = 0.7\nmin_fuzzy_confidence = 0.6\nevolutionary = false\ninference = wr\nweight_method = pcf\n")
    t = str(tmp_path)
    main(["run", "--config", f"{t}/c", "--header", f"{t}/h", "--train", f"{t}/d", "--test", f"{t}/d", "--model", f"{t}/m"], spark)
    again = FuzzyRuleModel.load(spark, f"{t}/m").rules
    assert [(r.items, r.cls) for r in again] == [(r.items, r.cls) for r in model.rules]
    assert [r.weight for r in again] == pytest.approx([r.weight for r in model.rules])  # sums come in any order
    assert "Accuracy" in files.read_text(spark, f"{t}/m/test/accuracy")


def test_bad_numbers_raise_or_drop(spark, model, tmp_path):
    (tmp_path / "d").write_text("0.5,?,p,hi\n 0.25 , 0.5 ,q, lo\n")
    with pytest.raises(Exception, match="no number"):
        files.read_table(spark, str(tmp_path / "d"), model.schema).collect()
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "d"), model.schema, "drop").collect()] == [(0.25, 0.5, "q", "lo")]
