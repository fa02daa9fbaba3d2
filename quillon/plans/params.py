"""Settings of the learner, and their `key = value` file form."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np


@dataclass(frozen=True)
class Params:
    # file keys
    best_genes_pct: float = 0.35
    bits_gene: int = 30
    cost_sensitive: bool = True
    evolutionary: bool = True
    fitness: str = "accuracy"
    inference: str = "winning_rule"
    max_attributes: int = 3
    max_evaluations: int = 10000
    max_restarts_no_improve: int = 3
    min_crisp_confidence: float = 1.0
    min_fuzzy_confidence: float = 1.0
    num_linguistic_labels: int = 5
    num_partitions: int = 0
    population_size: int = 50
    proportion_initial_rules_evolutionary: int = 1
    proportions_rule_lengths: tuple[float, ...] = (0.2, 0.3, 0.5)
    verbose: bool = False
    weight_method: str = "pcf"
    # what has no file key
    seed: int = 123456789
    quantiles: int = 1000
    crisp_support: float = 0.025
    fuzzy_support: float = 0.05
    median: float = 0.5
    top_factor: int = 2
    size_penalty: float = 0.15
    start_distance: float = 0.25
    distance_step: float = 0.01
    scale: str = "uniform"
    tie: str = "bisect"

    def __post_init__(self):
        if self.num_linguistic_labels < 2:
            raise ValueError("at least two labels are needed")
        if len(self.proportions_rule_lengths) != self.max_attributes:
            raise ValueError("one proportion for each rule length is needed")

    def rules_kept(self, length: int, variables: int, classes: int) -> int:
        """How many rules of a length are kept (of each class, if cost-sensitive). Products are 32-bit floats."""
        share = np.float32(self.proportions_rule_lengths[length - 1])
        per = self.top_factor * self.proportion_initial_rules_evolutionary * self.num_linguistic_labels * variables
        return math.ceil(np.float32(per if self.cost_sensitive else per * classes) * share)


KEYS = {f.name.replace("cost_sensitive", "cost-sensitive"): f for f in fields(Params) if f.name not in ("seed", "quantiles", "crisp_support", "fuzzy_support", "median", "top_factor", "size_penalty", "start_distance", "distance_step", "scale", "tie")}
#: Names that mean the same setting.
WINNING = {"wr", "winningrule", "winning_rule"}
PENALIZED = {"pcf", "penalizedcertaintyfactor", "penalized_certainty_factor"}
MEASURES = {"geometric mean": "gm", "geometric_mean": "gm", "geometric-mean": "gm", "gm": "gm", "average accuracy": "avgacc", "average_accuracy": "avgacc", "average-accuracy": "avgacc", "avgacc": "avgacc"}


def parse_config(text: str) -> tuple[Params, list[str]]:
    """Params and the lines that were not understood. Everything is taken in lower case."""
    found, unknown = {}, []
    for line in text.lower().splitlines():
        key, sep, value = line.strip().partition(" = ")
        f = KEYS.get(key)
        if not sep or f is None:
            unknown += [line] * bool(line.strip())
        elif f.name == "inference":
            found[f.name] = "winning_rule" if value in WINNING else "additive"
        elif f.name == "weight_method":
            found[f.name] = "pcf" if value in PENALIZED else "cf"
        elif f.name == "proportions_rule_lengths":
            found[f.name] = tuple(float(x) for x in value.split(","))
        elif f.type == "bool":
            found[f.name] = value == "true"
        else:
            found[f.name] = {"int": int, "float": float}.get(f.type, str)(value)
    return Params(**found), unknown


def to_config(p: Params) -> str:
    text = lambda v: str(v).lower() if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, tuple) else str(v)
    return "".join(f"{k} = {text(getattr(p, f.name))}\n" for k, f in sorted(KEYS.items()))


def measure_name(fitness: str) -> str:
    return MEASURES.get(fitness.lower(), "accuracy")
