"""Evolutionary rule selection (CHC), and rule selection with lateral tuning of the fuzzy sets.

Genetics run on the driver with a seeded generator; each generation is scored in one Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from quillon.functions.fuzzy import Triangle, displaced, gray_distance_of
from quillon.operators import scoring
from quillon.plans.params import Params, measure_name


@dataclass
class Individual:
    genes: np.ndarray  # bool, one for each rule
    tuning: np.ndarray | None = None  # [0, 1], one for each fuzzy set
    value: float = -math.inf


@dataclass
class Result:
    best: Individual
    log: list[dict] = field(default_factory=list)


def distance(a: Individual, b: Individual, bits: int) -> int:
    d = int((a.genes != b.genes).sum())
    if a.tuning is not None:
        d += sum(gray_distance_of(x, y, bits) for x, y in zip(a.tuning, b.tuning))
    return d


def half_uniform(a: np.ndarray, b: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Half of the differing genes, at random, are swapped."""
    differ = np.flatnonzero(a != b)
    take = rng.permutation(differ)[: math.ceil(len(differ) / 2)]
    x, y = a.copy(), b.copy()
    x[take], y[take] = b[take], a[take]
    return x, y


def blended(a: np.ndarray, b: np.ndarray, d: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """Parent-centric blend: a child near each parent, no farther than d times their distance."""
    reach = d * np.abs(a - b)
    draw = lambda c: rng.uniform(np.maximum(0, c - reach), np.minimum(1, c + reach))
    return draw(a), draw(b)


def fresh(rules: int, sets: int | None, rng) -> Individual:
    if sets is None:
        return Individual(rng.random(rules) < 0.5)
    genes = np.zeros(rules, bool)
    genes[rng.integers(0, rules, rules)] = True  # with replacement: about 63 % of them
    return Individual(genes, rng.random(sets))


def diverged(best: Individual, keep_share: float, rng) -> Individual:
    """From the best: each selected rule stays with chance 1 - keep_share, or gives way to a random one."""
    genes = np.zeros(len(best.genes), bool)
    for g in np.flatnonzero(best.genes):
        genes[g if rng.random() < 1 - keep_share else rng.integers(0, len(genes))] = True
    return Individual(genes, None if best.tuning is None else rng.random(len(best.tuning)))


def mated(population: list[Individual], limit: int, bits: int, blend: float, rng) -> list[Individual]:
    """Children of random pairs whose halved distance is over the limit; an odd one out stays single."""
    order, children = rng.permutation(len(population)), []
    for i in range(0, len(order) - 1, 2):
        a, b = population[order[i]], population[order[i + 1]]
        if distance(a, b, bits) // 2 > limit:
            x, y = half_uniform(a.genes, b.genes, rng)
            t = blended(a.tuning, b.tuning, blend, rng) if a.tuning is not None else (None, None)
            children += [Individual(x, t[0]), Individual(y, t[1])]
    return children


def search(score: Callable[[list[Individual]], list[float]], rules: int, p: Params, sets: int | None = None, blend: float = 1.0) -> Result:
    """score values a list of individuals, one job for all. sets: the number of fuzzy sets to tune, if any."""
    rng = np.random.default_rng(p.seed)
    start = math.ceil((rules + (sets or 0) * p.bits_gene) * p.start_distance) if sets else math.ceil(rules * p.start_distance)
    step = max(math.ceil((0.1 if sets else p.distance_step) * start), 1)
    first = Individual(np.ones(rules, bool), None if sets is None else np.full(sets, 0.5))
    population = [first, *(fresh(rules, sets, rng) for _ in range(p.population_size - 1))]

    def rate(group: list[Individual]) -> None:
        for x, v in zip(group, score(group) if group else []):
            x.value = -math.inf if math.isnan(v) else v

    ranked = lambda group: sorted(group, key=lambda x: -x.value)
    rate(population)
    population, used, limit, idle, log = ranked(population), len(population), start, 0, []
    best, generation = population[0], 0
    mark = best.value
    while used < p.max_evaluations and idle < p.max_restarts_no_improve and best.value < 1:
        children = mated(population, limit, p.bits_gene, blend, rng)[: p.max_evaluations - used]
        rate(children)
        used += len(children)
        if any(c.value > population[-1].value for c in children):
            population = ranked(population + children)[: p.population_size]
        else:
            limit -= step
        best = max([best, population[0]], key=lambda x: x.value)
        restart = limit <= 0
        log.append({"generation": generation, "evaluations": used, "best": float(best.value), "rules": int(best.genes.sum()), "distance": limit, "restart": restart})
        generation += 1
        if restart:
            idle = 0 if best.value > mark else idle + 1
            mark = best.value
            others = [diverged(best, p.best_genes_pct, rng) for _ in range(p.population_size - 1)][: max(0, p.max_evaluations - used)]
            rate(others)
            used += len(others)
            population, limit = ranked([best, *others]), start
            best = population[0]
    return Result(best, log)


def select_rules(matrix_rows, rules: list[scoring.Rule], classes: int, default: int, p: Params) -> Result:
    """CHC over the matching matrix (see scoring.matching_matrix)."""
    cls, measure = [r.cls for r in rules], measure_name(p.fitness)

    def score(group: list[Individual]) -> list[float]:
        tables = scoring.population_confusion(matrix_rows, np.array([x.genes for x in group]), cls, classes, default, p.inference)
        return [scoring.fitness(scoring.measures_of(t, measure), len(rules), int(x.genes.sum()), p.size_penalty) for t, x in zip(tables, group)]

    return search(score, len(rules), p)


def tuned_sets(sets: dict[str, list[Triangle]], tuning: np.ndarray) -> dict[str, list[Triangle]]:
    """The initial sets, each displaced by its gene."""
    out, at = {}, 0
    for name, own in sets.items():
        out[name] = displaced(own, list(tuning[at : at + len(own)]))
        at += len(own)
    return out


def select_and_tune(df, schema, sets: dict, rules: list[scoring.Rule], p: Params) -> tuple[Result, dict]:
    """CHC over rules and fuzzy sets. The matching depends on the sets, so each individual is matched
    anew, but all of a generation in one pass over the data."""
    from pyspark.sql import functions as F

    from quillon.functions.fuzzy import nominal_code
    from quillon.operators import itemsets as I
    from quillon.operators.rules import packed, products

    labels, measure, classes = p.num_linguistic_labels, measure_name(p.fitness), len(schema.classes)
    width = max(len(r.items) for r in rules)
    places, weights, cls = packed([list(r.items) for r in rules], schema, labels, width), np.array([r.weight for r in rules]), np.array([r.cls for r in rules])
    columns = [F.col(f"`{v.name}`").cast("double") if v.is_real else nominal_code(F.col(f"`{v.name}`"), v.values).cast("double") for v in schema.variables]
    rows = df.select(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns]).alias("x"), I.class_code(schema).alias("cls")).where("cls >= 0").persist()
    default = schema.default_class()

    def score(group: list[Individual]) -> list[float]:
        plans = [(x.genes, tuned_sets(sets, x.tuning)) for x in group]

        def run(batches):
            import pyarrow as pa

            total = np.zeros((len(plans), classes, classes), np.int64)
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                real = b.column(1).to_numpy(zero_copy_only=False)
                for k, (genes, own) in enumerate(plans):
                    m = products(membership_matrix(x, schema, own), places[genes]) * weights[genes]
                    np.add.at(total[k], (real, scoring.choose(m, cls[genes], classes, default, p.inference)[0]), 1)
            k, r, q = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (k, r, q)] + [pa.array(total[k, r, q])], ["chrom", "real", "pred", "n"])

        tables = np.zeros((len(plans), classes, classes))
        for r in rows.mapInArrow(run, "chrom int, real int, pred int, n long").groupBy("chrom", "real", "pred").agg(F.sum("n").alias("n")).collect():
            tables[r["chrom"], r["real"], r["pred"]] = r["n"]
        return [scoring.fitness(scoring.measures_of(t, measure), len(rules), int(x.genes.sum()), p.size_penalty) for t, x in zip(tables, group)]

    try:
        found = search(score, len(rules), p, sum(map(len, sets.values())))
    finally:
        rows.unpersist()
    return found, tuned_sets(sets, found.best.tuning)


def membership_matrix(x: np.ndarray, schema, sets: dict[str, list[Triangle]]) -> np.ndarray:
    """rows x places, as quillon.operators.rules.memberships has them, of values (codes of nominals)."""
    out = [np.ones(len(x))]
    with np.errstate(invalid="ignore", divide="ignore"):
        for i, v in enumerate(schema.variables):
            c = x[:, i]
            if not v.is_real:
                out += [(c == j).astype(float) for j in range(len(v.values))]
                continue
            for s in sets[v.name]:
                left = (c - s.left) / (s.mid - s.left) if s.left < s.mid else np.ones(len(c))
                right = (s.right - c) / (s.right - s.mid) if s.mid < s.right else np.ones(len(c))
                out.append(np.nan_to_num(np.clip(np.where(c < s.mid, left, np.where(c > s.mid, right, np.where(np.isnan(c), 0.0, 1.0))), 0, 1)))
    return np.stack(out, axis=1)
