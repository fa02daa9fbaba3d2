"""Packing by cutting-stock column generation.

Every document is cut at multiples of the sequence length; the full pieces fill sequences alone. The
rests are counted in a histogram of lengths (in units of `unit` tokens, rounded up). A linear program
over patterns (multisets of lengths that fit into one sequence) is solved by the revised simplex
method; a knapsack dynamic program over the dual prices finds each entering pattern. Pattern counts
are rounded down, the few rests left over are put by best fit into further patterns, and ranks of the
documents within their length are dealt to the patterns' places.

Histogram, program and patterns are bounded by sequence length / unit, whatever the input.
Documents, pieces and ranks stay distributed: ranks are taken in parts of a length, the more the oftener it stands.

Defined cases: null texts are empty documents, just the end id; very long texts are encoded whole and cut into
as many pieces as they need; repeated rows are packed each; an empty table gives no rows; ids that are null are kept; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, id_text, through
from quillon.llm.tokens import encoded, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = 1, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full ones of `most` ids and the rest."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        for b in batches:
            for lo, hi, got, at in encoded(enc, b.column(1), end_id):
                n = np.diff(at)
                many = -(-n // most)
                start = most * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                length = np.minimum(most, np.repeat(n, many) - start)
                place, raw = np.repeat(at[:-1], many) + start, memoryview(got.view(np.uint8))
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(place.tolist(), (place + length).tolist())]
                ids = b.column(0).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(np.repeat(np.arange(hi - lo), many)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (start, length, crc, np.repeat(n, many)))], [x.split()[0] for x in PIECES.split(", ")])
        enc.rest()

    return through(id_text(docs, id_col, text_col), run, PIECES)


def price(duals: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the dearest multiset of sizes 1..len(duals) within `size`."""
    m = len(duals)
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        k = min(c, m)
        value = best[c - k : c][::-1] + duals[:k]  # size 1..k
        j = int(np.argmax(value))
        best[c], took[c] = (value[j], j + 1) if value[j] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(m, np.int64), size
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return best[size], pattern


def solve(counts: np.ndarray, size: int, most_rounds: int = 4000, slack: float = 1e-7) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that cover counts[i] pieces of i+1 units, in sequences of `size` units."""
    there = np.flatnonzero(counts)
    if not len(there):
        return []
    sizes, need = there + 1, counts[there].astype(float)
    m = len(sizes)
    # each size alone, as often as it fits, is the first basis
    patterns = [np.where(np.arange(m) == i, size // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / np.array([size // s for s in sizes]))
    x = inverse @ need
    full = np.zeros(size)
    for n in range(most_rounds):
        if n % 200 == 199:
            inverse = np.linalg.inv(np.array(patterns, float).T)
            x = np.maximum(inverse @ need, 0)
        duals = inverse.sum(axis=0)
        full[:] = 0
        full[there] = np.maximum(duals, 0)
        value, found = price(full, size)
        if value <= 1 + slack:
            break
        entering = found[there].astype(float)
        way = inverse @ entering
        ok = way > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, way, 1), np.inf)
        out = int(np.argmin(ratio))
        x -= ratio[out] * way
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        patterns[out] = found[there]
    left, used = need.astype(np.int64), []
    for times, p in sorted(((int(t + 1e-6), p) for t, p in zip(x, patterns)), key=lambda y: -y[0]):
        while times and (p * times > left).any():
            times -= 1
        if times:
            left = left - p * times
            wide = np.zeros(len(counts), np.int64)
            wide[there] = p
            used.append((times, wide))
    # what is left over: largest first into the fullest bin that takes it
    by_room: dict[int, list[int]] = {}
    rooms, inside = [], []
    for i in range(m - 1, -1, -1):
        for _ in range(int(left[i])):
            s = int(sizes[i])
            room = next((r for r in range(s, size + 1) if by_room.get(r)), None)
            if room is None:
                rooms.append(size)
                inside.append(np.zeros(len(counts), np.int64))
                at, room = len(rooms) - 1, size
            else:
                at = by_room[room].pop()
            inside[at][there[i]] += 1
            rooms[at] = room - s
            by_room.setdefault(rooms[at], []).append(at)
    return used + [(1, p) for p in inside]


def pack(pieces: DataFrame, most: int = 2048, unit: int = 4, rows_a_group: int = 20_000) -> DataFrame:
    """pieces plus sequence_id and offset. pieces should be a written table: it is read three times.

    The ranks within a length are taken in groups of about rows_a_group rows, as many as the length's count asks for. A column `spread`
    of pieces, if there is one, deals them to the groups, else a hash of the row.
    """
    spark, size = pieces.sparkSession, most // unit
    names = [x.split()[0] for x in PIECES.split(", ")]
    rows = pieces.withColumn("bucket", F.ceil(F.col("length") / unit).cast("int"))
    counts = np.zeros(size, np.int64)
    for r in rows.groupBy("bucket").count().collect():  # at most size rows
        counts[r["bucket"] - 1] = r["count"]
    groups = np.maximum(1, -(-counts // rows_a_group))
    spread = F.col("spread") if "spread" in pieces.columns else F.xxhash64("doc_id", "start", "ids_crc32")
    rows = rows.withColumn("salt", F.pmod(spread, F.get(F.lit(groups), F.col("bucket") - 1)))
    before = [np.zeros(n + 1, np.int64) for n in groups]
    for r in rows.groupBy("bucket", "salt").count().toLocalIterator():  # size + rows / rows_a_group rows
        before[r["bucket"] - 1][r["salt"] + 1] = r["count"]
    before = [np.cumsum(b) for b in before]
    # places of each bucket: (first rank, first sequence, how many of it in the pattern, first slot)
    places: list[list] = [[] for _ in range(size)]
    ranks, sequence = [0] * size, 0
    for times, p in solve(counts, size):
        slot = 0
        for b in np.flatnonzero(p)[::-1].tolist():
            places[b].append((ranks[b], sequence, int(p[b]), slot))
            ranks[b] += times * int(p[b])
            slot += int(p[b])
        sequence += times
    box = spark.sparkContext.broadcast((before, [np.array(p, np.int64).reshape(-1, 4) for p in places]))

    def deal(batches):
        import pyarrow as pa

        before, places = box.value
        for batch in batches:
            b, s, r = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("bucket", "salt", "rank"))
            seq, slot = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for x in np.unique(b):
                at = np.flatnonzero(b == x)
                rank = before[x - 1][s[at]] + r[at]
                row = places[x - 1][np.searchsorted(places[x - 1][:, 0], rank, "right") - 1]
                own = rank - row[:, 0]
                seq[at], slot[at] = row[:, 1] + own // row[:, 2], row[:, 3] + own % row[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq), pa.array(slot)], [*names, "sequence_id", "slot"])

    def placed(some: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
        return through(some.withColumn("rank", rank).select(*names, "bucket", "salt", "rank"), deal, f"{PIECES}, sequence_id long, slot long")

    # pieces of the greatest length fill their sequences alone
    full = placed(rows.where(F.col("bucket") == size)).withColumn("offset", F.lit(0).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    rest = placed(rows.where(F.col("bucket") < size)).withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return full.unionByName(rest).drop("slot")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, most: int = 2048, unit: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pieces = pieces_of(docs, vocabulary, end_id, most, id_col, text_col).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    return pack(cut(pieces, "pieces"), most, unit)
