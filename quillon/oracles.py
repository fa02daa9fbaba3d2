"""SQL twins of the named queries, written apart from the DataFrame plans.

Each is a chain of common table expressions from the base tables: rows, cut points, scaled values, labels,
itemsets, thresholds, pruning, matching, weights, rules.
"""

from __future__ import annotations

from itertools import combinations

from quillon import fixtures as X
from quillon import queries as Q
from quillon.plans.params import Params

L, B, STEP = Q.LABELS, Q.BINS, 100


def with_chain(parts: list[str], last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + last


def cells(names) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS var, CAST({n} AS DOUBLE) AS value FROM base" for i, n in enumerate(names))


def cuts_parts(names) -> list[str]:
    """long(var, value), cuts(var, idx, q), size(var, q_n)"""
    return [
        f"long AS ({cells(names)})",
        "ordered AS (SELECT var, value, row_number() OVER (PARTITION BY var ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY var) AS n FROM long)",
        f"wanted AS (SELECT DISTINCT s.var, CAST(greatest(ceil((i.i::DOUBLE / {B}) * s.n - 1), 0) AS BIGINT) AS rk FROM (SELECT DISTINCT var, n FROM ordered) s, (SELECT unnest(range(1, {B + 1})) AS i) i)",
        "cuts AS (SELECT o.var, CAST(row_number() OVER (PARTITION BY o.var ORDER BY o.rk) - 1 AS INTEGER) AS idx, o.value AS q FROM ordered o JOIN wanted w ON o.var = w.var AND o.rk = w.rk)",
        "size AS (SELECT var, count(*) AS nq FROM cuts GROUP BY var)",
    ]


def scaled_parts(names) -> list[str]:
    """stop(var, value, i): where the halving search stops, for each different value; pit(var, value, u)"""
    return [
        *cuts_parts(names),
        "lists AS (SELECT var, list(q ORDER BY idx) AS qs, len(list(q)) AS nq FROM cuts GROUP BY var)",
        "bounds AS (SELECT var, min(value) AS lo FROM long GROUP BY var)",
        "vals AS (SELECT DISTINCT var, value FROM long)",
        # the search, all values at once
        """halving AS (
  SELECT v.var, v.value, 0 AS a, CAST(l.nq AS INTEGER) AS b, FALSE AS hit FROM vals v JOIN lists l ON v.var = l.var
  UNION ALL
  SELECT h.var, h.value,
    CASE WHEN l.qs[(h.a + h.b - 1) // 2 + 1] = h.value THEN (h.a + h.b - 1) // 2 WHEN h.value < l.qs[(h.a + h.b - 1) // 2 + 1] THEN h.a ELSE (h.a + h.b - 1) // 2 + 1 END,
    CASE WHEN l.qs[(h.a + h.b - 1) // 2 + 1] = h.value THEN (h.a + h.b - 1) // 2 WHEN h.value < l.qs[(h.a + h.b - 1) // 2 + 1] THEN (h.a + h.b - 1) // 2 ELSE h.b END,
    l.qs[(h.a + h.b - 1) // 2 + 1] = h.value
  FROM halving h JOIN lists l ON h.var = l.var WHERE NOT h.hit AND h.a < h.b)""",
        "stop AS (SELECT var, value, a AS i FROM halving WHERE hit OR a >= b)",
        """pit AS (SELECT t.var, t.value, CASE WHEN t.i >= l.nq THEN 1.0
    WHEN l.qs[t.i + 1] > (CASE WHEN t.i = 0 THEN b.lo ELSE l.qs[t.i] END)
    THEN t.i::DOUBLE / l.nq + (t.value - (CASE WHEN t.i = 0 THEN b.lo ELSE l.qs[t.i] END)) * ((t.i + 1)::DOUBLE / l.nq - t.i::DOUBLE / l.nq) / (l.qs[t.i + 1] - (CASE WHEN t.i = 0 THEN b.lo ELSE l.qs[t.i] END))
    ELSE t.i::DOUBLE / l.nq END AS u FROM stop t JOIN lists l ON t.var = l.var JOIN bounds b ON t.var = b.var)""",
    ]


def fixture_parts(f: X.Fixture, key: str = "") -> list[str]:
    """scaled: the fixture with reals on the uniform scale; u0.. the reals, then nominals, cls, class"""
    joins = " ".join(f"JOIN pit p{i} ON p{i}.var = {i} AND p{i}.value = CAST(base.{n} AS DOUBLE)" for i, n in enumerate(f.reals))
    picks = ", ".join([f"p{i}.u AS u{i}" for i in range(len(f.reals))] + [f"base.{n} AS s{i + len(f.reals)}" for i, n in enumerate(f.nominals)])
    return [
        f"base AS ({f.sql})", *scaled_parts(f.reals), f"classes AS (SELECT {f.label} AS class, CAST(row_number() OVER (ORDER BY {f.label}) - 1 AS INTEGER) AS cls, count(*) AS nc FROM base GROUP BY {f.label})",
        "costs AS (SELECT class, cls, nc, max(nc) OVER ()::DOUBLE / nc AS cost, (SELECT count(*) FROM base) AS total_n, count(*) OVER () AS n_classes FROM classes)",
        f"scaled AS MATERIALIZED (SELECT {picks}, c.cls, c.class{key} FROM base {joins} JOIN classes c ON c.class = base.{f.label})",
        *[f"dict{i + len(f.reals)} AS (SELECT {n} AS v, CAST(row_number() OVER (ORDER BY {n}) - 1 AS INTEGER) AS code FROM base GROUP BY {n})" for i, n in enumerate(f.nominals)],
    ]


def label_sql(u: str) -> str:
    h = 1 / (L - 1)
    whens = " ".join(f"WHEN {u} < {h * j + h / 2!r} THEN {j}" for j in range(L - 1))
    return f"(CASE {whens} ELSE {L - 1} END)"


def labels_part(f: X.Fixture, key: str = "") -> str:
    """labels: l0.. of every row"""
    n = len(f.reals)
    cols = [f"{label_sql(f'u{i}')} AS l{i}" for i in range(n)] + [f"d{i}.code AS l{i}" for i in range(n, n + len(f.nominals))]
    joins = " ".join(f"JOIN dict{i} d{i} ON d{i}.v = s{i}" for i in range(n, n + len(f.nominals)))
    return f"labels AS MATERIALIZED (SELECT {', '.join(cols)}, scaled.* FROM scaled {joins})"


def item_text_sql(f: X.Fixture, item: str) -> str:
    n = len(f.reals)
    real = " ".join(f"WHEN {item} // {STEP} = {i} THEN '{name}=L_' || ({item} % {STEP})" for i, name in enumerate(f.reals))
    nominal = " ".join(f"WHEN {item} // {STEP} = {i + n} THEN '{name}=' || (SELECT v FROM dict{i + n} WHERE code = {item} % {STEP})" for i, name in enumerate(f.nominals))
    return f"(CASE {real} {nominal} END)"


def itemset_parts(f: X.Fixture, p: Params) -> list[str]:
    """counted(itemset, len, cls, cov), rated(itemset, len, support, cls, conf, classes), frequent"""
    v = len(f.names)
    sets = [c for k in range(1, p.max_attributes + 1) for c in combinations(range(v), k)]
    grouped = " UNION ALL ".join(f"SELECT [{', '.join(f'{i * STEP} + l{i}' for i in c)}] AS itemset, {len(c)} AS len, cls, sum(n) AS n FROM cells GROUP BY {', '.join(f'l{i}' for i in c)}, cls" for c in sets)
    cost = "c.cost" if p.cost_sensitive else "1.0"
    by = "cls, len" if p.cost_sensitive else "len"
    same = " AND ".join(f"f.{c.strip()} = t.{c.strip()}" for c in by.split(","))
    return [
        labels_part(f), f"cells AS MATERIALIZED (SELECT {', '.join(f'l{i}' for i in range(v))}, cls, count(*) AS n FROM labels GROUP BY ALL)",
        f"counted AS MATERIALIZED (SELECT g.itemset, g.len, g.cls, g.n * {cost} AS cov FROM ({grouped}) g JOIN costs c ON c.cls = g.cls)",
        f"total AS (SELECT sum(nc * {'cost' if p.cost_sensitive else '1.0'}) AS t FROM costs)",
        "rated AS MATERIALIZED (SELECT itemset, len, sum(cov) / (SELECT t FROM total) AS support, arg_max(cls, cov * 1e6 - cls) AS cls, max(cov) / sum(cov) AS conf, list(cls ORDER BY cls) AS classes FROM counted GROUP BY itemset, len)",
        f"frequent AS MATERIALIZED (SELECT * FROM rated WHERE support > {p.crisp_support} / ((SELECT count(*) FROM classes) * len))",
        f"spread AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY conf DESC, itemset) - 1 AS rk, count(*) OVER (PARTITION BY {by}) AS n FROM frequent)",
        f"thresholds AS MATERIALIZED (SELECT {by}, least(conf, {p.min_crisp_confidence}) AS threshold FROM spread WHERE rk = least(ceil({p.median} * n), n - 1))",
        f"topped AS MATERIALIZED (SELECT f.* FROM frequent f JOIN thresholds t ON {same} WHERE f.conf >= t.threshold)",
        *prune_parts("topped", "pruned"),
    ]


def prune_parts(source: str, name: str) -> list[str]:
    return [
        f"{name}_items AS MATERIALIZED (SELECT itemset, len, conf, unnest(itemset) AS item FROM {source})",
        f"{name}_lead AS (SELECT item, itemset, len, conf FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY len, itemset) AS rk FROM {name}_items) WHERE rk = 1)",
        f"{name}_gone AS (SELECT DISTINCT r.itemset FROM {name}_items r JOIN {name}_lead l ON r.item = l.item WHERE r.len > l.len AND r.conf <= l.conf AND list_has_all(r.itemset, l.itemset))",
        f"{name} AS MATERIALIZED (SELECT * FROM {source} WHERE itemset NOT IN (SELECT itemset FROM {name}_gone))",
    ]


def member_sql(u: str, j: int) -> str:
    h = 1 / (L - 1)
    a, m, b = h * (j - 1), h * j, h * (j + 1)
    left = f"WHEN {u} > {a!r} AND {u} < {m!r} THEN ({u} - {a!r}) / {m - a!r}" if j else f"WHEN {u} < {m!r} THEN 1.0"
    right = f"WHEN {u} > {m!r} AND {u} < {b!r} THEN ({b!r} - {u}) / {b - m!r}" if j < L - 1 else f"WHEN {u} > {m!r} THEN 1.0"
    return f"(CASE WHEN {u} = {m!r} THEN 1.0 {left} {right} ELSE 0.0 END)"


def mu_part(f: X.Fixture, source: str = "labels", key: str = "") -> str:
    """mu: key, cls, m MAP-like list of the memberships at var * STEP + label, by two lists"""
    cells_ = [(i * STEP + j, member_sql(f"u{i}", j)) for i in range(len(f.reals)) for j in range(L)]
    names = ", ".join(f"{x} AS m{k}" for k, x in cells_)
    return f"mu AS MATERIALIZED (SELECT row_number() OVER () AS rid, {names}, {', '.join(f'l{i}' for i in range(len(f.reals), len(f.names)))}, cls{key} FROM {source})"


def active_part(f: X.Fixture) -> str:
    """active: rid, cls, item, m for the items of each row that have a membership above 0"""
    n = len(f.reals)
    real = [f"SELECT rid, cls, {i * STEP + j} AS item, m{i * STEP + j} AS m FROM mu WHERE m{i * STEP + j} > 0" for i in range(n) for j in range(L)]
    nominal = [f"SELECT rid, cls, {i * STEP} + l{i} AS item, 1.0 AS m FROM mu" for i in range(n, len(f.names))]
    return "active AS MATERIALIZED (" + " UNION ALL ".join(real + nominal) + ")"


def matching_parts(f: X.Fixture, p: Params) -> list[str]:
    """matched(itemset, len, cls, m)"""
    one = "SELECT r.itemset, r.len, a.cls, sum(a.m) AS m FROM rules r JOIN active a ON a.item = r.itemset[1] WHERE r.len = 1 GROUP BY ALL"
    two = "SELECT r.itemset, r.len, a.cls, sum(a.m * b.m) AS m FROM rules r JOIN active a ON a.item = r.itemset[1] JOIN active b ON b.rid = a.rid AND b.item = r.itemset[2] WHERE r.len = 2 GROUP BY ALL"
    three = "SELECT r.itemset, r.len, a.cls, sum(a.m * b.m * c.m) AS m FROM rules r JOIN active a ON a.item = r.itemset[1] JOIN active b ON b.rid = a.rid AND b.item = r.itemset[2] JOIN active c ON c.rid = a.rid AND c.item = r.itemset[3] WHERE r.len = 3 GROUP BY ALL"
    cost = "c.cost" if p.cost_sensitive else "1.0"
    # by cell of equal memberships nothing would be gained: the join on active items is the product of non-zero factors
    return [mu_part(f), active_part(f), "rules AS MATERIALIZED (SELECT itemset, len, classes FROM pruned)", f"matched AS MATERIALIZED (SELECT g.itemset, g.len, g.cls, g.m * {cost} AS m FROM ({one} UNION ALL {two} UNION ALL {three}) g JOIN costs c ON c.cls = g.cls)"]


def weight_parts(f: X.Fixture, p: Params) -> list[str]:
    v, weight = len(f.names), "(2 * m - s) / s" if p.weight_method == "pcf" else "m / s"
    by = "cls, len" if p.cost_sensitive else "len"
    most = " ".join(f"WHEN {k} THEN {p.rules_kept(k, v, 3)}" for k in range(1, p.max_attributes + 1))
    return [
        *matching_parts(f, p),
        "summed AS (SELECT *, sum(m) OVER (PARTITION BY itemset) AS s FROM matched)",
        f"weighted AS MATERIALIZED (SELECT w.itemset, w.len, w.cls, {weight} AS weight, m / (SELECT count(*) FROM base) AS support, m / s AS conf FROM summed w JOIN rules r ON r.itemset = w.itemset WHERE list_contains(r.classes, w.cls) AND s > 0)",
        f"resolved AS MATERIALIZED (SELECT itemset, len, cls, weight, support, conf FROM (SELECT *, row_number() OVER (PARTITION BY itemset ORDER BY weight DESC, cls) AS rk FROM weighted) WHERE rk = 1 AND weight > 0 AND support >= {p.fuzzy_support} / ((SELECT count(*) FROM classes) * len) AND conf >= {p.min_fuzzy_confidence})",
        f"kept AS MATERIALIZED (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY weight DESC, itemset) AS rk FROM resolved) WHERE rk <= CASE len {most} END)",
        *prune_parts("kept", "final"),
    ]


def items_sql(f: X.Fixture, source: str) -> str:
    """The rows of source with items, the itemset as text."""
    return f"(SELECT s.*, i.items FROM {source} s JOIN (SELECT itemset, string_agg(txt, ' & ' ORDER BY item) AS items FROM (SELECT itemset, item, {item_text_sql(f, 'item')} AS txt FROM (SELECT DISTINCT itemset, unnest(itemset) AS item FROM (SELECT DISTINCT itemset FROM {source}))) GROUP BY itemset) i ON i.itemset = s.itemset)"


def on_f(p: Params, upto: str, last: str) -> str:
    f = X.F_TIER
    parts = [*fixture_parts(f), *itemset_parts(f, p)]
    return with_chain(parts + (weight_parts(f, p) if upto == "rules" else []), last)


def listed(source: str, cols: str, f: X.Fixture = X.F_TIER) -> str:
    return f"SELECT items, CAST(len AS INTEGER) AS len, c.class, {cols} FROM {items_sql(f, source)} x JOIN classes c ON c.cls = x.cls"


CAND = "round(support, 6) AS support, round(conf, 6) AS conf"
RULE = "round(weight, 5) AS weight, round(support, 5) AS support, round(conf, 5) AS conf"


def scoring_parts(genes=None) -> list[str]:
    """best(o_orderkey, cls, rule, m): every rule's weighted matching on G"""
    f = X.G_VAL
    n = len(f.reals)

    def factor(v, j):
        return member_sql(f"u{v}", j) if v < n else f"(CASE WHEN l{v} = {j} THEN 1.0 ELSE 0.0 END)"

    rules = [(k, r) for k, r in enumerate(Q.RULES) if genes is None or genes[k]]
    rows = " UNION ALL ".join(f"SELECT o_orderkey, cls AS real, {k} AS rule, {c} AS cls, {' * '.join(factor(v, j) for v, j in items)} * {w} AS m FROM labels" for k, (items, c, w) in rules)
    return [*fixture_parts(f, ", o_orderkey"), labels_part(f), f"matched AS MATERIALIZED ({rows})", "fallback AS (SELECT cls FROM classes ORDER BY nc DESC, cls LIMIT 1)"]


WIN = "won AS MATERIALIZED (SELECT o_orderkey, real, CASE WHEN m > 0 THEN cls ELSE (SELECT cls FROM fallback) END AS pred, greatest(m, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY m DESC, rule) AS rk FROM matched) WHERE rk = 1)"
ADD = "won AS MATERIALIZED (SELECT o_orderkey, real, CASE WHEN m > 0 THEN cls ELSE (SELECT cls FROM fallback) END AS pred, greatest(m, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY m DESC, cls) AS rk FROM (SELECT o_orderkey, real, cls, sum(m) AS m FROM matched GROUP BY ALL)) WHERE rk = 1)"
SCORED = "SELECT o_orderkey, c.class, round(score, 5) AS score FROM won JOIN classes c ON c.cls = won.pred"
TABLE = "table_ AS (SELECT a.cls AS real, b.cls AS pred, (SELECT count(*) FROM won w WHERE w.real = a.cls AND w.pred = b.cls) AS n FROM classes a, classes b)"
RATES = "rates AS (SELECT real, sum(n) AS n, sum(CASE WHEN real = pred THEN n ELSE 0 END) AS hit, sum(CASE WHEN real = pred THEN n ELSE 0 END)::DOUBLE / sum(n) AS rate FROM table_ GROUP BY real)"


def fitness_sql() -> str:
    picks = " UNION ALL ".join(f"SELECT {k} AS chrom, {r} AS rule" for k, genes in enumerate(Q.POPULATION) for r, on in enumerate(genes) if on)
    n = len(Q.RULES)
    return with_chain([
        *scoring_parts(), f"genes AS ({picks})",
        "won AS MATERIALIZED (SELECT chrom, o_orderkey, real, CASE WHEN m > 0 THEN cls ELSE (SELECT cls FROM fallback) END AS pred FROM (SELECT g.chrom, t.*, row_number() OVER (PARTITION BY g.chrom, o_orderkey ORDER BY m DESC, t.rule) AS rk FROM matched t JOIN genes g ON g.rule = t.rule) WHERE rk = 1)",
        "rates AS (SELECT chrom, real, count(*) AS n, sum(CASE WHEN real = pred THEN 1 ELSE 0 END) AS hit FROM won GROUP BY chrom, real)",
        "sizes AS (SELECT chrom, count(*) AS k FROM genes GROUP BY chrom)",
    ], f"""SELECT CAST(r.chrom AS INTEGER) AS chrom, CAST(k AS INTEGER) AS k, round(sum(hit)::DOUBLE / sum(n) - {n}::DOUBLE / ({n} - k + 1) * 0.15, 6) AS by_accuracy,
  round(power(product(hit::DOUBLE / n), 1.0 / count(*)) - {n}::DOUBLE / ({n} - k + 1) * 0.15, 6) AS by_gm, round(avg(hit::DOUBLE / n) - {n}::DOUBLE / ({n} - k + 1) * 0.15, 6) AS by_avg
FROM rates r JOIN sizes s ON s.chrom = r.chrom GROUP BY r.chrom, k""")


def best_subset_sql() -> str:
    """Each of the 2^n - 1 subsets, and the fitness of the best."""
    n = len(Q.RULES)
    return with_chain([
        *scoring_parts(), f"subsets AS (SELECT unnest(range(1, {2**n})) AS s)",
        "won AS MATERIALIZED (SELECT s, o_orderkey, real, max(m) AS top, arg_max(cls, {'m': m, 'first': -rule}) AS cls FROM matched, subsets WHERE (s >> rule) & 1 = 1 GROUP BY ALL)",
        "rates AS (SELECT s, real, sum(CASE WHEN real = (CASE WHEN top > 0 THEN cls ELSE (SELECT cls FROM fallback) END) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS rate FROM won GROUP BY s, real)",
        f"rated AS (SELECT s, power(product(rate), 1.0 / count(*)) - {n}::DOUBLE / ({n} - bit_count(s) + 1) * 0.15 AS fit FROM rates GROUP BY s)",
    ], "SELECT round(max(fit), 6) AS best FROM rated")


def training_sql() -> str:
    """Cut points and bounds of the training rows; the search for the values of the others."""
    f = X.G_VAL
    parts = [f"whole AS ({f.sql})", "base AS (SELECT * FROM whole WHERE o_orderkey % 4 <> 0)", f"test AS ({cells(f.reals).replace('FROM base', 'FROM whole WHERE o_orderkey % 4 = 0')})"]
    parts += [x.replace("vals AS (SELECT DISTINCT var, value FROM long)", "vals AS (SELECT DISTINCT var, value FROM test)") for x in scaled_parts(f.reals)]
    joins = " ".join(f"JOIN pit p{i} ON p{i}.var = {i} AND p{i}.value = CAST(w.{n} AS DOUBLE)" for i, n in enumerate(f.reals))
    return with_chain(parts, f"SELECT o_orderkey, {', '.join(f'round(p{i}.u, 6) AS {n}' for i, n in enumerate(f.reals))} FROM whole w {joins} WHERE o_orderkey % 4 = 0")


def header_sql() -> str:
    f = X.F_TIER
    rows = [f"SELECT '{n}' AS name, 'real' AS kind, min({n}) AS lo, max({n}) AS hi, '' AS vals FROM base" for n in f.reals]
    rows += [f"SELECT '{n}', 'nominal', NULL, NULL, string_agg(DISTINCT {n}, ',' ORDER BY {n}) FROM base" for n in f.nominals]
    return f"WITH base AS ({f.sql}) " + " UNION ALL ".join(rows)


def config_sql() -> str:
    """The settings as literals: what was written comes back, and the line that no key has."""
    said = {
        "best_genes_pct": "0.35", "bits_gene": "30", "cost-sensitive": "true", "evolutionary": "false", "fitness": "accuracy", "inference": "winning_rule", "max_attributes": "3", "max_evaluations": "10000", "max_restarts_no_improve": "3",
        "min_crisp_confidence": "0.7", "min_fuzzy_confidence": "0.6", "num_linguistic_labels": "5", "num_partitions": "0", "population_size": "50", "proportion_initial_rules_evolutionary": "2", "proportions_rule_lengths": "0.2,0.3,0.5", "verbose": "false", "weight_method": "pcf",
        "not understood": "unknown = 1",
    }
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in said.items()) + ") AS t(name, value)"


def set_rows(first: int = 0) -> str:
    h = 1 / (L - 1)
    return " UNION ALL ".join(f"SELECT {i} AS var, {j} AS label, {h * max(j - 1, 0)!r} AS l, {h * j!r} AS m, {h * min(j + 1, L - 1)!r} AS r" for i in range(4) for j in range(L))


STATS = [f"sets AS ({set_rows()})", "us AS (" + " UNION ALL ".join(f"SELECT {i} AS var, u{i} AS u FROM scaled" for i in range(4)) + ")", "stats AS MATERIALIZED (SELECT s.var, s.label, s.l, s.m, s.r, coalesce(sum(u.u), 0) AS total, count(u.u) AS n FROM sets s LEFT JOIN us u ON u.var = s.var AND u.u BETWEEN s.l AND s.r GROUP BY ALL)"]
PRICE = "base AS (SELECT l_extendedprice FROM lineitem)"
BACK = "CASE WHEN u >= 1 THEN (SELECT max(value) FROM long) WHEN u <= 0 THEN (SELECT min(value) FROM long) ELSE (SELECT CASE WHEN k = 0 THEN (SELECT min(value) FROM long) ELSE qs[k] END + (u * nq - k) * (qs[k + 1] - CASE WHEN k = 0 THEN (SELECT min(value) FROM long) ELSE qs[k] END) FROM (SELECT qs, nq, CAST(least(floor(u * nq), nq - 1) AS INTEGER) AS k FROM lists)) END"
INVERSE = [PRICE, *cuts_parts(["l_extendedprice"]), "lists AS (SELECT list(q ORDER BY idx) AS qs, count(*) AS nq FROM cuts)"]
GRID = "SELECT i / 500.0::DOUBLE AS a, (i * 7 % 500) / 500.0::DOUBLE AS b FROM (SELECT unnest(range(0, 500)) AS i)"
GRAY = lambda c: f"xor(CAST(floor({c} * 1073741823.0::DOUBLE + 0.5) AS BIGINT), CAST(floor({c} * 1073741823.0::DOUBLE + 0.5) AS BIGINT) >> 1)"


def all_sql() -> dict[str, str]:
    f, p = X.F_TIER, Q.P
    names = ", ".join(f"l{i} AS {n}" for i, n in enumerate(f.names))
    out = {
        "class_cost": f"WITH c AS (SELECT {X.TIER} AS class, count(*) AS n FROM lineitem GROUP BY 1) SELECT class, n, round(max(n) OVER ()::DOUBLE / n, 6) AS cost, round(n::DOUBLE / sum(n) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY n DESC, class) = 1 AS INTEGER) AS is_default FROM c",
        "quantile_cuts": with_chain(["base AS (SELECT l_extendedprice, l_quantity FROM lineitem)", *cuts_parts(["l_extendedprice", "l_quantity"])], "SELECT CAST(var AS INTEGER) AS var, idx, q FROM cuts"),
        "pit_transform": with_chain([f"base AS ({f.sql})", *scaled_parts(f.reals)], "SELECT CAST(l.var AS INTEGER) AS var, round(p.u, 6) AS value, count(*) AS n FROM long l JOIN pit p ON p.var = l.var AND p.value = l.value GROUP BY 1, 2"),
        "pit_inverse": with_chain(INVERSE, f"SELECT u, round({BACK}, 4) AS value FROM (SELECT i / 2000.0::DOUBLE AS u FROM (SELECT unnest(range(0, 2001)) AS i))"),
        "log_scaled": "WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, round(CASE WHEN lo < 0 THEN ln(greatest(c_acctbal - lo + 1, 1.0)) WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE 0.0 END, 6) AS logged, round(CASE WHEN lo > 0 THEN ln(lo) ELSE 0.0 END, 6) AS lo, round(CASE WHEN lo > 0 THEN ln(hi) ELSE ln(hi - lo + 1) END, 6) AS hi FROM customer, b",
        "nominal_codes": "WITH v AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'] AS vs), c AS (SELECT o_orderpriority, CAST(coalesce(list_position(vs, o_orderpriority), 0) - 1 AS INTEGER) AS code, count(*) AS n FROM orders, v GROUP BY 1, 2) SELECT o_orderpriority, code, n, code / 4.0::DOUBLE AS share, CASE WHEN code >= 0 THEN o_orderpriority END AS back, CASE WHEN code >= 0 THEN o_orderpriority END AS value FROM c",
        "crisp_labels": with_chain([*fixture_parts(f), labels_part(f)], f"SELECT {', '.join(f'CAST(l{i} AS INTEGER) AS {n}' for i, n in enumerate(f.names))}, count(*) AS n FROM labels GROUP BY ALL"),
        "membership_long": with_chain([*fixture_parts(f), labels_part(f), mu_part(f), active_part(f), "grid AS (" + " UNION ALL ".join([f"SELECT {i} AS var, unnest(range(0, {L})) AS label" for i in range(4)] + [f"SELECT {i} AS var, code AS label FROM dict{i}" for i in (4, 5)]) + ")"], f"SELECT CAST(g.var AS INTEGER) AS var, CAST(g.label AS INTEGER) AS label, round(coalesce(sum(a.m), 0), 3) AS total, count(a.m) AS n FROM grid g LEFT JOIN active a ON a.item = g.var * {STEP} + g.label GROUP BY 1, 2"),
        "crisp_cells": on_f(p, "", f"SELECT {names}, c.class, n FROM cells JOIN classes c ON c.cls = cells.cls".replace("l4 AS", "CAST(l4 AS INTEGER) AS").replace("l5 AS", "CAST(l5 AS INTEGER) AS")),
        "candidate_itemsets": on_f(p, "", listed("counted", "round(cov, 6) AS cov")),
        "frequent_itemsets": on_f(p, "", listed("frequent", CAND)),
        "confidence_thresholds": on_f(p, "", "SELECT c.class, CAST(len AS INTEGER) AS len, round(threshold, 6) AS threshold FROM thresholds t JOIN classes c ON c.cls = t.cls"),
        "confidence_thresholds_plain": with_chain([*fixture_parts(X.G_VAL), *itemset_parts(X.G_VAL, Q.PLAIN)], "SELECT CAST(len AS INTEGER) AS len, round(threshold, 6) AS threshold FROM thresholds"),
        "top_itemsets": on_f(p, "", listed("topped", CAND)),
        "pruned_itemsets": on_f(p, "", listed("pruned", CAND)),
        "rule_class_matching": on_f(p, "rules", listed("matched", "round(m, 2) AS m")),
        "rule_weights_pcf": on_f(p, "rules", listed("weighted", RULE)),
        "rule_weights_cf": on_f(Q.CF, "rules", listed("weighted", RULE)),
        "resolved_rules": on_f(p, "rules", listed("resolved", RULE)),
        "topk_rules": on_f(p, "rules", listed("kept", RULE)),
        "topk_rules_plain": on_f(Q.PLAIN, "rules", listed("kept", RULE)),
        "final_rules": on_f(p, "rules", listed("final", RULE)),
        "rule_text": on_f(p, "rules", f"SELECT 'IF ' || replace(replace(items, ' & ', ' AND '), '=', ' IS ') || ' THEN CLASS ' || c.class || ' WITH RW = ' || format('{{:.4f}}', weight) AS text FROM {items_sql(f, 'final')} x JOIN classes c ON c.cls = x.cls"),
        "rulebase_stats": on_f(p, "rules", "SELECT c.class, count(f.itemset) AS n_rules, round(avg(f.len), 6) AS mean_len, round(avg(f.weight), 5) AS mean_weight FROM classes c LEFT JOIN final f ON f.cls = c.cls GROUP BY c.class"),
        "classify_winning": with_chain([*scoring_parts(), WIN], SCORED),
        "classify_additive": with_chain([*scoring_parts(), ADD], SCORED),
        "classify_selected": with_chain([*scoring_parts(Q.POPULATION[1]), WIN], SCORED),
        "confusion_matrix": with_chain([*scoring_parts(), WIN, TABLE], "SELECT a.class AS real, b.class AS pred, n FROM table_ t JOIN classes a ON a.cls = t.real JOIN classes b ON b.cls = t.pred"),
        "accuracy_stats": with_chain([*scoring_parts(), WIN, TABLE, RATES], "SELECT round(sum(hit)::DOUBLE / sum(n), 6) AS accuracy, round(power(product(rate), 1.0 / count(*)), 6) AS gm, round(avg(rate), 6) AS avg_accuracy FROM rates"),
        "matching_matrix": with_chain(scoring_parts(), "SELECT c.class, CAST(rule AS INTEGER) AS rule, round(sum(m), 3) AS total FROM matched t JOIN classes c ON c.cls = t.real GROUP BY 1, 2"),
        "chromosome_fitness": fitness_sql(),
        "fuzzyset_stats": with_chain([*fixture_parts(f), *STATS], "SELECT CAST(var AS INTEGER) AS var, CAST(label AS INTEGER) AS label, round(total, 3) AS total, n FROM stats"),
        "recentred_sets": with_chain([*fixture_parts(f), *STATS], "SELECT CAST(var AS INTEGER) AS var, CAST(label AS INTEGER) AS label, " + ", ".join(f"round({c} + CASE WHEN n > 0 THEN total / n - m ELSE 0 END, 5) AS {c}" for c in "lmr") + " FROM stats"),
        "translated_sets": with_chain(INVERSE, "SELECT CAST(j AS INTEGER) AS label, " + ", ".join(f"round({BACK.replace('u >', e + ' >').replace('u <', e + ' <').replace('u *', e + ' *')}, 4) AS {c}" for c, e in (("l", "(greatest(j - 1, 0) / 4.0)"), ("m", "(j / 4.0)"), ("r", "(least(j + 1, 4) / 4.0)"))) + " FROM (SELECT unnest(range(0, 5))::DOUBLE AS j)"),
        "lateral_shift": "SELECT CAST(j AS INTEGER) AS label, " + ", ".join(f"round({e} + (g - 0.5) * 0.25, 6) AS {c}" for c, e in (("l", "greatest(j - 1, 0) / 4.0"), ("m", "j / 4.0"), ("r", "least(j + 1, 4) / 4.0"))) + " FROM (SELECT unnest(range(0, 5))::DOUBLE AS j, unnest([0.5, 0.25, 0.75, 0.1, 0.9])::DOUBLE AS g)",
        "gray_hamming": f"SELECT a, b, CAST(bit_count(xor({GRAY('a')}, {GRAY('b')})) AS INTEGER) AS d FROM ({GRID})",
        "pcblx_bounds": f"SELECT a, b, round(greatest(0.0, a - abs(a - b)), 6) AS lo, round(least(1.0, a + abs(a - b)), 6) AS hi FROM ({GRID})",
        "histogram10": "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), h AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 10.0)), 9) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) / 10.0 * b, 4) AS lo, round(lo + (hi - lo) / 10.0 * (b + 1), 4) AS hi, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 10)) AS b) LEFT JOIN h ON h.bin = b, e",
    }
    c = X.C_QUALITY
    out |= {
        "rule_numbers": on_f(p, "", f"SELECT items, CAST(len AS INTEGER) AS len, CAST(row_number() OVER (ORDER BY len, itemset) - 1 AS INTEGER) AS rule FROM {items_sql(f, 'pruned')} x"),
        "candidates_checkpoint": out["pruned_itemsets"],
        "delimited_rows": f"SELECT val, o_orderstatus, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS price, round(min(c_acctbal), 2) AS least FROM ({X.G_VAL.sql}) GROUP BY ALL",
        "training_cuts": training_sql(),
        "saved_model_classify": out["classify_winning"],
        "confusion_report": with_chain([*scoring_parts(), WIN, TABLE], "SELECT string_agg(n, chr(9) ORDER BY pred) AS line FROM table_ GROUP BY real"),
        "chc_best": best_subset_sql(),
        "header_roundtrip": header_sql(),
        "config_roundtrip": config_sql(),
        "itemset_ranking": with_chain([*fixture_parts(c), *itemset_parts(c, p)], listed("rated", CAND, c)),
    }
    return out


SQL = all_sql()
