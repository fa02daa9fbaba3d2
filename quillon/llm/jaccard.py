"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal sets of n-grams are one row of the matrix. Two rows can reach the threshold t only if
they share one of the n - ceil(t n) + 1 columns that come first in a fixed order of all columns (rarer first,
as a bounded sample sees it: the order steers only the cost, never the result). The product over
these columns names the pairs; pairs whose sizes, or whose overlap over these columns, rule out the threshold
are discarded at once; for the rest the overlap is counted over all columns and compared exactly.

The product is taken in two passes, so that no group's pairs are all written out. First each row goes, in
each of a few turns, to one block: rows that share a column, as many as a task can take. A block's product is
counted over all its columns within the task, which hands on fewer edges than the block has rows. Then the columns
that still hold rows of different components are multiplied, but only across components and across blocks,
and only where the places of the column in both rows leave room for the overlap that is needed: what stands
before the first shared column is shared by no one. So rows that are alike but not enough meet in no column.
Columns that would still make many pairs are multiplied tile by tile, each within a task that hands on fewer
edges than it has rows. What is left out has been counted in a block or lies within a component already, so the
components are those of all links.

Defined cases: null texts and texts without words have the empty set and link with nothing; with fewer
words than n, the whole sequence is the one n-gram; repeated rows are equal documents; rows whose id is
null come back with a null component and link with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillon.llm.common import commonest, crc_mod, cut, free, id_text, through

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased (A-Z) words."""

    def __init__(self, n: int, most: int = 200_000):
        self.n, self.most = n, most
        self._clear()

    def _clear(self) -> None:
        self.slot: defaultdict = defaultdict()
        self.slot.default_factory = self.slot.__len__
        self.hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.slot) > self.most:
            self._clear()
        known, get = len(self.slot), self.slot.__getitem__
        words = [t.encode().lower().split() if t else [] for t in texts]
        ids = [np.fromiter(map(get, w), np.int64, len(w)) for w in words]
        if len(self.slot) > known:
            fresh = list(self.slot)[known:]
            self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh)))
        return [self._set(self.hashes[i]) for i in ids]

    def _set(self, h: np.ndarray) -> np.ndarray:
        n = min(self.n, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            s = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                s = (s ^ h[k : len(h) - n + 1 + k]) * MULTIPLIERS[k % 8]
                s ^= s >> np.uint64(29)
        return np.unique(s)


def batches_of(batches, shingler):
    """(batch, sets) in runs of a few MB."""
    from quillon.llm.tokens import chunks

    for b in batches:
        texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        for lo, hi in chunks(texts, 2_000_000):
            yield b.slice(lo, hi - lo), shingler.sets(texts[lo:hi])


def common_columns(rows: DataFrame, n: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The (at most `most`) columns that stand in three or more of about `sample` documents, with their counts."""
    there = rows.count()
    part = max(1, there // sample)
    picked = rows.where(crc_mod(F.col("doc_id"), part) == 0) if part > 1 else rows

    def run(batches):
        import pyarrow as pa

        for _, sets in batches_of(batches, Shingler(n)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    seen = cut(through(picked.select("text"), run, "h long").groupBy("h").count().where("count >= 3"), "join-common")
    seen = commonest(seen, "count", most).collect()
    h = np.array([r.h for r in seen], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in seen], np.int64)[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def documents_rows(rows: DataFrame, n: int, percent: int, common: tuple) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the set) and the first columns of each document."""
    box = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        import pyarrow as pa

        h, count = box.value
        for b, sets in batches_of(batches, Shingler(n)):
            own, first = [], []
            for s in sets:
                own.append(xxhash.xxh3_128_digest(s.tobytes()))
                k = prefix_length(len(s), percent) if len(s) else 0
                if len(h) and k:
                    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    s = s[np.argsort(np.where(h[at] == s, count[at], 0), kind="stable")]
                first.append(s[:k].view(np.int64))
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.binary()), lists], ["doc_id", "n_shingles", "set_id", "first"])

    return through(rows, run, "doc_id long, n_shingles long, set_id binary, first array<long>")


def whole_sets(ids: DataFrame, nodes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """ids (node and more) with the nodes' whole sets: their documents are read again.

    A document that is repeated brings its set again; another text under the same id is left out.
    """
    met = cut(ids.join(nodes.select("node", "set_id", F.col("rep").alias("doc_id")), "node"), "join-met")
    few = met.limit(2_000_001).count() <= 2_000_000
    names = ids.columns
    found = rows.join(F.broadcast(met) if few else met.hint("shuffle_merge"), "doc_id").select("text", "set_id", *names)

    def run(batches):
        import pyarrow as pa

        for b, sets in batches_of(batches, Shingler(n)):
            own = [xxhash.xxh3_128_digest(s.tobytes()) == i for s, i in zip(sets, b.column(1).to_pylist())]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], lists], [*names, "columns"]).filter(pa.array(own, pa.bool_()))

    return through(found, run, ", ".join(f"`{c}` {t}" for c, t in ids.dtypes) + ", columns array<long>")


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, comp (least node of its component) for every node of edges (a, b), by alternating stars.

    Each turn is a few grouped minima over the edges; it ends when a turn changes nothing.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), label)
    digest = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    known = digest(edges)
    while True:
        # large star: every greater neighbour gets the least node around
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), label)
        # small star: a node and its lesser neighbours get the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        pulled = large.join(least, "b")
        edges = cut(pulled.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(pulled.select(F.col("m").alias("a"), "b")).where("a < b").distinct(), label)
        now = digest(edges)
        if now == known:
            break
        known = now
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def least_overlap(na, nb, percent: int):
    """The overlap at which two sets of these sizes reach the threshold."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def index_length(n, percent: int):
    """So many columns of a row that is the smaller of a pair come into question: the overlap is at least that of equal sizes."""
    return n - F.ceil(2 * percent * n / (100 + percent)) + 1


def room(na, ia, nb, ib, percent: int):
    """Whether two rows whose first shared column stands at these places may reach the threshold: all from there on may be shared."""
    return F.least(na - ia, nb - ib) >= least_overlap(na, nb, percent)


def within_reach(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, counted over their first columns, leaves the threshold within reach.

    One of the two lists ends earlier in the order of the columns. What both rows share up to there stands in both
    lists; the rest is at most what that row has beyond its list. So far fewer whole sets are moved to be compared.
    """
    left = lists.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("first").alias("fa"))
    right = lists.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb"))
    beyond = F.greatest(F.col("na") - F.size("fa"), F.col("nb") - F.size("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    return pairs.join(left, "a").join(right, "b").where(both + beyond >= least_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose overlap, counted over all columns, reaches the threshold."""
    sets = cut(whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows, n), "join-sets")
    left = sets.select(F.col("node").alias("a"), F.col("columns").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("columns").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb"))
    return cut(pairs.join(left, "a").join(right, "b").where(both >= least_overlap(F.size("ca"), F.size("cb"), percent)).select("a", "b").distinct(), "join-links")


def overlaps(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """The block's sparse product: how many columns each two of its rows share.

    Columns in many rows are multiplied as dense slabs, the others add 1 for each of their pairs.
    """
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    row, starts = row[np.argsort(column, kind="stable")], np.cumsum(df) - df
    many = max(2, m // 8)
    dense = np.flatnonzero(df >= many)
    for k in range(0, len(dense), wide):
        slab = np.zeros((m, len(dense[k : k + wide])), np.float32)
        for j, c in enumerate(dense[k : k + wide]):
            slab[row[starts[c] : starts[c] + df[c]], j] = 1
        out += slab @ slab.T
    for d in np.unique(df[(df > 1) & (df < many)]).tolist():
        own, step = starts[df == d], max(1, 4_000_000 // (d * d))
        for k in range(0, len(own), step):
            at = row[own[k : k + step, None] + np.arange(d)]
            out += np.bincount((at[:, :, None] * m + at[:, None, :]).ravel(), minlength=m * m).reshape(m, m)
    return out


def block_links(table, percent: int):
    """(a, b) that join the rows of a block that its links connect: fewer than it has rows."""
    import pyarrow as pa

    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    sets = [s.values.to_numpy() for s in table.column("columns").take(pa.array(first))]
    both, size = overlaps(sets), np.array([len(s) for s in sets], float)
    linked = np.empty(both.shape, bool)
    for i in range(0, len(size), 256):
        linked[i : i + 256] = (100 + percent) * both[i : i + 256].astype(float) >= percent * (size[i : i + 256, None] + size[None, :])
    root, left = np.full(len(nodes), -1), np.ones(len(nodes), bool)
    for i in np.argsort(nodes):
        front = np.array([i]) if left[i] else np.zeros(0, np.int64)
        while len(front):
            root[front], left[front] = i, False
            front = np.flatnonzero(linked[front].any(axis=0) & left)
    other = root != np.arange(len(nodes))
    return pa.table({"a": pa.array(nodes[root[other]]), "b": pa.array(nodes[other])})


def choose_blocks(posts: DataFrame, comps: DataFrame | None, earlier: DataFrame | None, rows_a_block: int = 512, columns_a_block: int = 1_000_000, least: int = 32) -> DataFrame:
    """node, h, part: each row goes to the fullest of its columns that hold different components.

    Blocks are split by a hash of the row so that each fits a task, however many rows share the column.
    """
    told = posts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else posts.withColumn("comp", F.col("node"))
    told = told.join(earlier, ["node", "h"], "left_anti") if earlier is not None else told
    full = told.groupBy("h").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(f"lo < hi and rows >= {least}")
    full = cut(full.select("h", "rows", F.greatest(F.ceil(F.col("rows") / rows_a_block), F.ceil(F.col("size") / columns_a_block)).alias("parts")), "join-full")
    best = posts.join(full, "h")
    best = (best.join(earlier, ["node", "h"], "left_anti") if earlier is not None else best).groupBy("node").agg(F.max(F.struct("rows", "h", "parts")).alias("best"))
    return cut(best.select("node", F.col("best.h").alias("h"), F.pmod(F.xxhash64("node", "best.h"), F.col("best.parts")).alias("part")), "join-blocks")


def block_product(blocks: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what the links within each block connect."""
    sets = whole_sets(blocks, nodes, rows, n)
    return cut(sets.groupBy("h", "part").applyInArrow(lambda t: block_links(t, percent), "a long, b long"), "join-edges")


def across_blocks(posts: DataFrame, lists: DataFrame, comps: DataFrame, blocks: list[DataFrame], nodes: DataFrame, rows: DataFrame, n: int, percent: int, most_pairs: int) -> DataFrame:
    """Edges (a, b) that connect what links across components and blocks connect: the second pass.

    Of a column's rows most are often of one component by now. They need not meet each other, only the rest: a
    column's product is that of the rest's leading rows by all, and of the other leading rows by the rest.
    """
    told = posts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    for i, b in enumerate(blocks):
        told = told.join(b.select("node", F.struct("h", "part").alias(f"block{i}")), "node", "left")
    told = cut(told, "join-told")
    lead = F.sum(F.col("leads").cast("long"))
    each = told.groupBy("h", "comp").agg(F.count("*").alias("rows"), lead.alias("leading"), F.sum("n").alias("size"))
    by = each.groupBy("h").agg(F.max(F.struct("rows", "comp", "leading")).alias("most"), F.sum("rows").alias("rows"), F.sum("leading").alias("leading"), F.sum("size").alias("size")).where("rows > most.rows and leading > 0")
    pairs = F.expr("(leading - most.leading) * rows + most.leading * (rows - most.rows)")
    by = cut(by.select("h", F.col("most.comp").alias("main"), "rows", "leading", "size", (pairs > most_pairs).alias("full")), "join-mixed")
    told = told.join(by.select("h", "main", "full"), "h").withColumn("rest", F.col("comp") != F.col("main")).drop("main")
    told = cut(told, "join-open")

    def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        on = (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") <= F.col("y.n")) & (100 * F.col("x.n") >= percent * F.col("y.n")) & room(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent)
        for i in range(len(blocks)):
            on = on & F.coalesce(F.col(f"x.block{i}") != F.col(f"y.block{i}"), F.lit(True))
        return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    few = told.where("not full")
    pairs = pairs_of(few.where("leads and rest"), few).unionByName(pairs_of(few.where("leads and not rest"), few.where("rest")))
    pairs = within_reach(cut(pairs.distinct(), "join-across"), lists, percent)
    found = verified(cut(pairs, "join-reach"), nodes, rows, n, percent)
    if by.where("full").isEmpty():
        return found
    return found.unionByName(tiles(told.where("full"), by.where("full"), nodes, rows, n, percent))


def tiles(told: DataFrame, by: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int, rows_a_side: int = 1024, columns_a_side: int = 1_000_000) -> DataFrame:
    """Edges that connect what links in the full columns connect: leading rows by rows, part by part."""
    parts = F.greatest(F.ceil(F.col("rows") / rows_a_side), F.ceil(F.col("size") / columns_a_side)).cast("int")
    own = told.join(by.select("h", parts.alias("parts")), "h").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # rect 0: the rest's leading rows by all; rect 1: the main component's leading rows by the rest
    left = own.where("leads").select("node", "h", F.col("rest").alias("rect"), F.col("part").alias("i"), F.explode(every).alias("j"))
    right = own.select("node", "h", F.lit(True).alias("rect"), "part", every.alias("every")).unionByName(own.where("rest").select("node", "h", F.lit(False).alias("rect"), "part", every.alias("every")))
    right = right.select("node", "h", "rect", F.explode("every").alias("i"), F.col("part").alias("j"))
    sets = cut(whole_sets(told.select("node").distinct(), nodes, rows, n), "join-sets")
    placed = left.unionByName(right).distinct().join(sets, "node")
    return cut(placed.groupBy("h", "rect", "i", "j").applyInArrow(lambda t: block_links(t, percent), "a long, b long"), "join-tiles")


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, most_common: int = 500_000, turns: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return linked(docs, n, percent, id_col, text_col, sample, most_common, turns).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, most_common: int = 500_000, turns: int = 2, most_pairs: int = 1_000_000) -> DataFrame:
    """join() with each row's set_id and whether its set is the one that stays of its component."""
    rows = id_text(docs, id_col, text_col)
    per_doc = cut(documents_rows(rows, n, percent, common_columns(rows, n, sample, most_common)), "join-docs")
    filled = per_doc.where("n_shingles > 0 and doc_id is not null")
    # one node for each different set
    nodes = filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    # the columns of one row of each set: a row with the least id, once
    own = filled.select("set_id", "doc_id", "first").join(nodes.select("set_id", F.col("rep").alias("doc_id"), "node", "n"), ["set_id", "doc_id"])
    lists = cut(own.dropDuplicates(["node"]).select("node", "n", "first"), "join-lists")
    posts = lists.select("node", "n", F.posexplode("first").alias("place", "h")).withColumn("leads", F.col("place") < index_length(F.col("n"), percent))
    led = cut(posts.groupBy("h").agg(F.count("*").alias("rows"), F.max("leads").alias("leads")).where("rows > 1 and leads").select("h"), "join-led")
    posts = cut(posts.join(led, "h"), "join-shared")
    # first pass: blocks of rows of one column, turn by turn
    comps, edges, blocks = None, None, []
    for _ in range(turns):
        earlier = [b.select("node", "h") for b in blocks]
        blocks.append(choose_blocks(posts, comps, reduce(DataFrame.unionByName, earlier) if earlier else None))
        found = block_product(blocks[-1], nodes, rows, n, percent)
        edges = found if edges is None else edges.unionByName(found)
        comps = cut(components(edges, "join-comps"), "join-linked")
    across = across_blocks(posts, lists, comps, blocks, nodes, rows, n, percent, most_pairs)
    comps = cut(components(edges.unionByName(across), "join-comps"), "join-final")
    # from nodes to ids: the least id of a component, then of each set
    ids = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = ids.groupBy("comp").agg(F.min(F.struct("rep", "set_id")).alias("least"))
    own = F.struct(F.col("least.rep").alias("component_id"), (F.col("least.set_id") == F.col("set_id")).alias("stays"))
    named = cut(ids.join(least, "comp").select("set_id", own.alias("own"), "copies"), "join-named")
    return with_component(per_doc, named)


def with_component(per_doc: DataFrame, named: DataFrame, parts: int = 10_000) -> DataFrame:
    """Sets held by more than one in `parts` documents, so fewer than `parts` sets, are sent to every task;
    the others meet their documents in a join without hot keys."""
    hot = per_doc.count() // parts
    common = F.broadcast(named.where(F.col("copies") > hot).select("set_id", F.col("own").alias("hot"))) if hot else None
    rows = per_doc.select("doc_id", "n_shingles", "set_id")
    rows = rows.join(common, "set_id", "left") if hot else rows.withColumn("hot", F.lit(None).cast(named.schema["own"].dataType))
    key = F.when(F.col("hot").isNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))
    rare = named.where(F.col("copies") <= hot) if hot else named
    # rows that need no partner carry a key of their own, so they are spread evenly
    rows = rows.withColumn("key", F.coalesce(key, F.xxhash64("doc_id").cast("string").cast("binary")))
    rows = rows.join(rare.select(F.col("set_id").alias("key"), "own"), "key", "left").withColumn("own", F.coalesce("hot", "own"))
    own = F.when(F.col("n_shingles") > 0, F.col("own.component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "set_id", F.coalesce("own.stays", F.lit(True)).alias("stays"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that another row of their component replaces: of the least id's rows one stays.

    A row is judged by its own text: rows of one id whose texts do not link all stay, as do rows without words.
    """
    found = cut(linked(docs, n, percent, id_col, text_col), "join-found")
    own_set, gone_id, gone_set = (free(docs, x) for x in ("_set", "_gone", "_gone_set"))
    ids = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice"))
    ids = cut(ids, "join-repeated")
    gone = found.where("component_id <> doc_id or not stays")
    if ids.isEmpty():
        return without(docs, gone.select(F.col("doc_id").alias(gone_id)), docs[id_col] == F.col(gone_id))
    gone = gone.join(ids, F.col("doc_id") == F.col("twice"), "left").select(F.col("doc_id").alias(gone_id), F.col("set_id").alias(gone_set), F.col("twice").isNotNull().alias("many"))
    gone, twice = cut(gone.distinct(), "join-gone"), ids.select(F.col("twice").alias(gone_id))
    once = docs.join(twice, docs[id_col] == F.col(gone_id), "left_anti")
    once = without(once, gone.where("not many").select(gone_id), F.col(id_col) == F.col(gone_id))
    rows = with_set(docs.join(twice, docs[id_col] == F.col(gone_id), "left_semi"), n, text_col, own_set)
    rows = without(rows, gone.where("many").select(gone_id, gone_set), (F.col(id_col) == F.col(gone_id)) & (F.col(own_set) == F.col(gone_set)))
    full = rows.where(F.col(own_set).isNotNull()).dropDuplicates([id_col, own_set])
    return once.unionByName(full.drop(own_set)).unionByName(rows.where(F.col(own_set).isNull()).drop(own_set))


def without(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    gone = cut(gone, "join-gone")
    return docs.join(F.broadcast(gone) if gone.count() <= 2_000_000 else gone.hint("shuffle_merge"), on, "left_anti")


def with_set(docs: DataFrame, n: int, text_col: str, name: str) -> DataFrame:
    """docs with the 128 bits of each row's set, null if it is empty."""
    place, names = docs.columns.index(text_col), [*docs.columns, name]

    def run(batches):
        import pyarrow as pa

        from quillon.llm.tokens import chunks

        shingler = Shingler(n)
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            for lo, hi in chunks(texts, 2_000_000):
                own = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in shingler.sets(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(own, pa.binary())], names)

    return through(docs, run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
