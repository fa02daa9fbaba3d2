"""Secret scans with a randomness test battery, in DataFrame functions alone.

Base spans are matches of three patterns. The method looks at runs of 20 and more token characters:
the encoding is inferred (hex, base32, one-case letters, base64; decimals are no secrets), and under
it come a chi-squared test of uniform symbols, a runs test (upper against lower half of the alphabet) and
a lag-1 serial-correlation test. A run that passes these counts as random. As a discovery it needs a
small p-value against text: the number of equal pairs of symbols that text would show at that length,
set against the chi-squared statistic. Weighted Benjamini-Hochberg over all runs of the
corpus, with weights by length, bounds the share of false discoveries; its threshold comes from a
histogram of bounded size, rounded to the strict side.

Defined cases: null texts count as empty and have no span; positions are code points; repeated rows
are scanned each; overlapping base spans of different kinds all stay; a method span that overlaps a
base span is left out; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free, id_text

# The three patterns of the contract.
KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX, TOKEN = "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{20,}"
HEX_LONG = "[0-9a-f]{24,}"  # maximal runs, so the same matches as HEX with 24 characters or more
KINDS = ("assign", "access", "hex", "random")

#: Inferred encodings: pattern, alphabet, and for text in it the chances that two and that three symbols are equal.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", 1.0, 1.0),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.10, 0.0125),
    ("letters", r"^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.065, 0.0055),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 0.065, 0.0055),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.05, 0.004),
)
BLOCK, BINS_A_DECADE, MOST_BIN = 128, 20, 6000
PART = 1024  # code points


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, use=None, zero: int = 0) -> Column:
    """The sum (or the fold by `use`) of the entries before each entry, in about len * BLOCK steps.

    values should be a column or a value of let(): it is looked at again and again.
    """
    add = lambda a, x: use(a, x) if use else a + x
    zero, n = F.lit(zero).cast("int"), F.size(values)
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(upto(F.ceil(n / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    starts = let(blocks, lambda s: F.transform(upto(F.size(s)), lambda b: F.aggregate(F.slice(s, F.lit(1), b), zero, add)))
    own = lambda s, i: add(F.get(s, F.floor(i / BLOCK).cast("int")), F.aggregate(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, add))
    return let(starts, lambda s: F.transform(upto(n), lambda i: own(s, i)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, hit, part>> of all matches, in code points; none where there is no match."""
    kind = "array<struct<start:int,end:int,hit:string,part:string>>"

    def build(x):
        gaps = F.transform(F.split(x, pattern, -1), lambda p: F.length(p))
        hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        return let(gaps, lambda g: let(hits, lambda h: placed(g, h, F.regexp_extract_all(x, F.lit(pattern), F.lit(group)) if group else h)))

    def placed(gaps, hits, parts):
        at = F.zip_with(before(gaps), gaps, lambda a, g: a + g)  # gaps up to and with each one
        had = let(F.transform(hits, lambda h: F.length(h)), lambda v: before(v))
        rows = F.arrays_zip(F.slice(at, F.lit(1), F.size(hits)).alias("gap"), had.alias("had"), hits.alias("hit"), parts.alias("part"))
        return F.transform(rows, lambda r: F.struct((r["gap"] + r["had"]).alias("start"), (r["gap"] + r["had"] + F.length(r["hit"])).alias("end"), r["hit"].alias("hit"), r["part"].alias("part")))

    return F.when(text.rlike(pattern), build(text)).otherwise(F.array().cast(kind))


def span(m: Column, kind: int) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def as_span(kind: int):
    return lambda m: span(m, kind)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>>, sorted by start, then kind as listed."""
    kinds = (
        F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= 6),
        F.filter(matches(text, ACCESS), lambda m: F.length(m["hit"]) >= 20),
        matches(text, HEX_LONG),
    )
    return F.array_sort(F.concat(*[F.transform(a, as_span(k)) for k, a in enumerate(kinds)]))


def log_tail(z: Column) -> Column:
    """log of the upper tail of the standard normal distribution (a polynomial fit, good to 7 digits near 0)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    up = -z * z / 2 - 0.5 * math.log(2 * math.pi) + F.log(poly)
    return F.when(z >= 0, up).otherwise(F.log1p(-F.exp(F.least(up, F.lit(-1e-12)))))


def battery(hit: Column) -> Column:
    """struct<n, encoding, log_chi, log_runs, log_serial, log_text>: natural logs of the p-values.

    The first three are against uniform symbols, the last against text. Decimals get log_text 0.
    """
    n = F.length(hit).cast("double")
    which = None
    for k, (_, pattern, _, _, _) in enumerate(ENCODINGS):
        which = F.when(hit.rlike(pattern), k) if which is None else which.when(hit.rlike(pattern), k) if pattern else which.otherwise(k)
    by = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)

    def tests(k):
        alphabet, a = by(k, [e[2] for e in ENCODINGS]), by(k, [float(len(e[2])) for e in ENCODINGS])
        plain = F.when(k == len(ENCODINGS) - 1, F.translate(hit, "-_", "+/")).otherwise(F.lower(hit))

        def on(chars):
            each = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(plain, c, F.lit(""))))
            squares = F.aggregate(each, F.lit(0.0), lambda s, c: s + c * c)

            def of(v):
                high = F.transform(v, lambda x: (x >= a / 2).cast("double"))
                n1 = F.aggregate(high, F.lit(0.0), lambda s, x: s + x)
                n2 = n - n1
                tail = lambda y: F.slice(y, F.lit(2), F.size(y) - 1)
                head = lambda y: F.slice(y, F.lit(1), F.size(y) - 1)
                changes = let(high, lambda y: F.aggregate(F.zip_with(head(y), tail(y), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, x: s + x))
                var_runs = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
                z_runs = F.when(var_runs > 0, (1 + changes - (2 * n1 * n2 / n + 1)) / F.sqrt(F.greatest(var_runs, F.lit(1e-9)))).otherwise(F.lit(99.0))
                mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
                var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
                cov = F.aggregate(F.zip_with(head(v), tail(v), lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, x: s + x)
                z_serial = F.when(var > 0, cov / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(99.0))
                return F.struct(z_runs.alias("runs"), z_serial.alias("serial"), squares.alias("squares"))

            return let(F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1), lambda v: let(of(v), finish))

        def finish(s):
            df = a - 1
            chi = a / n * s["squares"] - n
            z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            pairs, equal = n * (n - 1) / 2, (s["squares"] - n) / 2  # equal pairs: the chi-squared statistic in other units
            two, three = by(k, [e[3] for e in ENCODINGS]), by(k, [e[4] for e in ENCODINGS])
            spread = F.sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * F.greatest(three - two * two, F.lit(0.0)) + 1e-9)
            both = lambda z: F.least(F.lit(0.0), log_tail(F.abs(z)) + math.log(2))
            return F.struct(n.cast("int").alias("n"), k.alias("encoding"), log_tail(z_chi).alias("log_chi"), both(s["runs"]).alias("log_runs"), both(s["serial"]).alias("log_serial"), F.when(k == 0, F.lit(0.0)).otherwise(log_tail((pairs * two - equal) / spread)).alias("log_text"))

        return let(F.split(plain, ""), on)

    return let(which, tests)


def looks_random(t: Column, level: float = 0.01) -> Column:
    """No test of the battery speaks against uniform symbols (each at a third of the level)."""
    least = math.log(level / 3)
    return (t["encoding"] > 0) & (t["log_chi"] >= least) & (t["log_runs"] >= least) & (t["log_serial"] >= least)


def capped(n: Column) -> Column:
    return F.least(n, F.lit(64)).cast("double")


def false_discovery_threshold(docs: DataFrame, text_col: str = "text", share: float = 0.05) -> tuple[float, float]:
    """(mean capped length, least log10 of a weighted p-value) over all runs; (1, -inf) if none may be found.

    Two aggregates: one row, and a histogram of at most MOST_BIN + 1 rows.
    """
    t = F.coalesce(docs[text_col], F.lit(""))
    tests = docs.select(F.explode(matches(t, TOKEN)).alias("m")).select(battery(F.col("m.hit")).alias("t")).select(capped(F.col("t.n")).alias("size"), F.col("t.log_text").alias("p"))
    # the weight of a length is its share of the mean, so the histogram is taken by length, then weighted
    cells = tests.groupBy("size", F.least(F.floor(-F.col("p") / math.log(10) * BINS_A_DECADE), F.lit(MOST_BIN)).cast("int").alias("bin")).count().collect()
    total = sum(r["count"] for r in cells)
    if not total:
        return 1.0, -math.inf
    mean = sum(r["size"] * r["count"] for r in cells) / total
    bins: dict[int, int] = {}
    for r in cells:  # rounded down: p is never taken for smaller than it is
        b = math.floor(r["bin"] + math.log10(r["size"] / mean) * BINS_A_DECADE)
        bins[b] = bins.get(b, 0) + r["count"]
    found, least = 0, -math.inf
    for b in sorted(bins, reverse=True):
        found += bins[b]
        if 10 ** (-b / BINS_A_DECADE) <= share * found / total:
            least = -b / BINS_A_DECADE
    return mean, least


def all_spans(text: Column, base: Column, threshold: tuple[float, float]) -> Column:
    """base spans and those of the method, sorted by start, then kind."""
    mean, most = threshold
    if most == -math.inf:
        return base

    def found(m):
        def test(t):
            p = F.floor(F.least(-t["log_text"] / math.log(10) * BINS_A_DECADE, F.lit(float(MOST_BIN)))) + F.log10(capped(t["n"]) / mean) * BINS_A_DECADE
            return looks_random(t) & (F.floor(p) >= round(-most * BINS_A_DECADE))

        return let(battery(m["hit"]), test)

    more = F.transform(F.filter(matches(text, TOKEN), found), lambda m: span(m, 3))
    return let(more, lambda r: F.when(F.size(r) == 0, base).otherwise(let(F.array_sort(F.concat(base, r)), apart)))


def apart(spans: Column) -> Column:
    """Sorted spans without those of the method that overlap a base span.

    A span overlaps one that begins no later if the greatest end so far lies behind its start, else the next one.
    """
    late, is_base = 2**31 - 1, lambda s: s["kind"] < 3
    ends = let(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), lambda v: before(v, F.greatest))
    starts = let(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(late))), lambda v: F.reverse(before(v, F.least, late)))
    told = F.arrays_zip(spans.alias("span"), ends.alias("had"), starts.alias("next"))
    clear = lambda x: is_base(x["span"]) | ((x["had"] <= x["span"]["start"]) & (x["next"] >= x["span"]["end"]))
    return F.transform(F.filter(told, clear), lambda x: x["span"])


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, threshold: tuple[float, float], text_col: str, base: str, spans: str) -> DataFrame:
    """docs plus the two columns of spans: a projection, so nothing is shuffled or stored."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn(base, base_spans(t)).withColumn(spans, all_spans(t, F.col(f"`{base}`"), threshold))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row."""
    rows = with_spans(id_text(docs, id_col, text_col), false_discovery_threshold(docs, text_col, share), "text", "base", "found")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[n(k) for k in range(4)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def between(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that is given in parts of PART code points: only the parts in question are read."""

    def piece(c):
        lo = F.greatest(a - c * PART, F.lit(0))
        return F.substr(F.get(parts, c), lo + 1, F.least(b - c * PART, F.lit(PART)) - lo)

    at = lambda x: F.floor(x / PART).cast("int")
    return F.when(b > a, F.array_join(F.transform(F.sequence(at(a), F.greatest(at(a), at(b - 1))), piece), "")).otherwise("")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark for each run of overlapping spans, in time in proportion to the text and the spans."""

    def build(parts, had):
        told = F.arrays_zip(spans.alias("span"), had.alias("had"))
        # a span that begins within an earlier one has no text before it and no mark of its own
        out = F.transform(told, lambda x: F.when(x["span"]["start"] >= x["had"], F.concat(between(parts, x["had"], x["span"]["start"]), F.lit(mark))).otherwise(""))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(out, ""), between(parts, end, F.length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    return let(parts, lambda p: let(let(F.transform(spans, lambda s: s["end"]), lambda v: before(v, F.greatest)), lambda had: build(p, had)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", share: float = 0.05) -> DataFrame:
    """docs with every span's text replaced by the mark (overlapping spans by one); the columns stay, whatever their names."""
    threshold = false_discovery_threshold(docs, text_col, share)
    base, spans, text = free(docs, "_base"), free(docs, "_spans"), F.col(f"`{text_col}`")
    told = with_spans(docs, threshold, text_col, base, spans)
    return told.withColumn(text_col, F.when(F.size(spans) > 0, masked(text, F.col(spans), mark)).otherwise(text)).drop(base, spans)
