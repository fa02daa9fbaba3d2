"""Benchmark decontamination by BM25 retrieval over an inverted index of the test items.

Test items are cut into entries of at most ENTRY words. Every passage of every training document (windows
of twice that, at steps of ENTRY words, so any copy of an entry lies whole in one) is a query against the
index. Impacts are divided by the entry's own best score, so one threshold holds for all; block-max WAND
retrieves all entries at or above it. Passages that cannot reach it for any entry, as too few of the terms
without which none can get there (the essential lists) stand in them, are passed over at once. Each one retrieved is verified: of the question's and of the
answer's five-word shingles enough must stand in the passage.

An item is a question and an answer if its row has a value in a column of one of these names. Of a single text, the last fifth of
the words is reported as the answer, but as that is only assumed, the whole text's shingles decide. The index is as large as the benchmark: one of up to `most_words` words
is sent to every task; a larger one is taken in parts of that size, each over all documents and with the
whole benchmark's document frequencies, number of entries and mean length, so scores are those of one index.

Defined cases: documents and items that are null or without words match nothing; items of under five
words are one shingle; equal items are all reported; a repeated document is reported as often; an empty
table of either kind gives no rows. Ids are carried, whatever else the tables hold.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import cut, id_text, through

WORD = re.compile(r"\w+")
ENTRY, SHINGLE, BLOCK = 64, 5, 16
K1, B = 1.2, 0.75
LEAST_THRESHOLD = 0.4  # thresholds below it are refused
OUT = "score double, question_overlap double, answer_overlap double, first_word long, last_word long"  # after the two ids


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> list[tuple]:
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def entries_of(words: list[str]) -> list[list[str]]:
    parts = max(1, -(-len(words) // ENTRY))
    size = -(-len(words) // parts) if words else 0
    return [words[i : i + size] for i in range(0, len(words), size or 1)]


class Index:
    """Postings by term, in blocks of BLOCK entries with the block's greatest impact.

    `stats` (number of entries, their words, document frequency by term) is that of all parts, if items are one part.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], stats: tuple | None = None):
        self.items = items  # (item id, question words, answer words, whether they are but assumed parts of one text)
        self.entries = []  # (item number, words)
        for k, (_, q, a, *_) in enumerate(items):
            self.entries += [(k, words) for words in entries_of(q + a)]
        if stats is None:
            stats = len(self.entries), sum(len(w) for _, w in self.entries), Counter(w for _, words in self.entries for w in set(words))
        n, total, df = stats
        mean = total / n if n else 1.0
        self.slot, postings = {}, defaultdict(list)
        for e, (_, words) in enumerate(self.entries):
            tf, norm = Counter(words), K1 * (1 - B + B * len(words) / mean)
            impact = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            best = sum(impact.values())
            for w, x in impact.items():
                postings[self.slot.setdefault(w, len(self.slot))].append((e, x / best))
        self.lists = [np.array([e for e, _ in postings[t]], np.int64) for t in range(len(self.slot))]
        self.impacts = [np.array([x for _, x in postings[t]]) for t in range(len(self.slot))]
        self.blocks = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impacts]
        self.most = np.array([x.max() for x in self.impacts] or [0.0])
        self._split()
        self.q_shingles = [set(shingles(q)) for _, q, *_ in items]
        self.a_shingles = [set(shingles(a)) for _, _, a, *_ in items]
        self.whole = [set(shingles(q + a)) if any(one) else None for _, q, a, *one in items]

    def _split(self, threshold_share: float = 0.5) -> None:
        """Common terms are those, by falling frequency, that together give no entry over `threshold_share` of
        any threshold; the others are essential: an entry cannot reach the threshold without them."""
        common = np.zeros(len(self.entries))
        self.essential = np.ones(len(self.lists), bool)
        for t in sorted(range(len(self.lists)), key=lambda t: -len(self.lists[t])):
            more = common[self.lists[t]] + self.impacts[t]
            if len(self.lists[t]) > 1 and more.max() <= threshold_share * LEAST_THRESHOLD:
                common[self.lists[t]] = more
                self.essential[t] = False
        self.common = common  # what the common terms can give each entry at most

    def possible(self, terms: np.ndarray, threshold: float) -> bool:
        """Whether some entry can reach the threshold: by its own essential terms and the most its common ones give."""
        if not len(terms):
            return False
        entries = np.concatenate([self.lists[t] for t in terms])
        got = np.bincount(entries, np.concatenate([self.impacts[t] for t in terms]), len(self.common))
        return bool((got[entries] + self.common[entries] >= threshold - 1e-9).any())

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All entries with a score of at least threshold for the distinct terms: block-max WAND."""
        at = {int(t): 0 for t in terms}
        live, found = list(at), []
        head = lambda t: self.lists[t][at[t]]

        def seek(t, entry):
            at[t] += int(np.searchsorted(self.lists[t][at[t] :], entry))

        while live:
            live.sort(key=head)
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            entry = head(live[pivot])
            while pivot + 1 < len(live) and head(live[pivot + 1]) == entry:
                pivot += 1
            near = live[: pivot + 1]
            # the blocks that would hold the entry, and how far their bounds reach
            bound, reach = 0.0, np.iinfo(np.int64).max
            for t in near:
                b = (at[t] + int(np.searchsorted(self.lists[t][at[t] :], entry))) // BLOCK
                if b < len(self.blocks[t]):
                    bound += self.blocks[t][b]
                    end = (b + 1) * BLOCK
                    reach = min(reach, int(self.lists[t][end]) if end < len(self.lists[t]) else reach)
            if pivot + 1 < len(live):
                reach = min(reach, int(head(live[pivot + 1])))
            if bound < threshold:
                for t in near:
                    seek(t, max(reach, entry + 1))
            elif head(live[0]) == entry:
                score = sum(self.impacts[t][at[t]] for t in near)
                if score >= threshold - 1e-12:
                    found.append((int(entry), float(score)))
                for t in near:
                    at[t] += 1
            else:
                for t in near:
                    seek(t, entry)
            live = [t for t in live if at[t] < len(self.lists[t])]
        return found

    def leaks(self, words: list[str], threshold: float, overlap: float) -> list[tuple]:
        """(item id, score, question overlap, answer overlap, first word, last word) of one document."""
        get = self.slot.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if not len(ids) or not self.entries:
            return []
        best: dict[int, tuple] = {}
        place = np.flatnonzero((ids >= 0) & self.essential[ids])
        if not self.possible(np.unique(ids[place]), threshold):
            return []
        starts = np.arange(0, max(1, len(ids) - ENTRY), ENTRY)
        ends = np.minimum(starts + 2 * ENTRY, len(ids))
        for s, e, i, j in zip(starts.tolist(), ends.tolist(), np.searchsorted(place, starts), np.searchsorted(place, ends)):
            if not self.possible(np.unique(ids[place[i:j]]), threshold):
                continue
            terms = np.unique(ids[s:e])
            terms = terms[terms >= 0]
            found = self.search(terms, threshold)
            for k, score in {self.entries[i][0]: x for i, x in sorted(found, key=lambda f: f[1])}.items():
                # verified in the passage and its surroundings: an item of several entries spans passages
                long = len(self.items[k][1]) + len(self.items[k][2])
                lo, hi = max(0, s - long), min(len(words), e + long)
                there = set(shingles(words[lo:hi])) if long >= SHINGLE else {tuple(words[i : i + n]) for n in {len(self.items[k][1]), len(self.items[k][2])} for i in range(lo, hi - n + 1)}
                share = lambda own: len(own & there) / len(own) if own else 1.0
                q, a = share(self._in(self.q_shingles[k], long)), share(self._in(self.a_shingles[k], long))
                enough = min(q, a) if self.whole[k] is None else share(self._in(self.whole[k], long))
                if enough >= overlap and (k not in best or score > best[k][0]):
                    best[k] = (score, q, a, s, e)
        return [(self.items[k][0], *x) for k, x in sorted(best.items())]

    @staticmethod
    def _in(own: set, long: int) -> set:
        """Shingles that have the passage's length; a short question or answer in a long item is left to the rest."""
        return own if long < SHINGLE else {x for x in own if len(x) == SHINGLE}


def items_of(rows, answer_share: float = 0.2) -> list[tuple[int, list[str], list[str], bool]]:
    out = []
    for r in rows:
        one = r["question"] is None and r["answer"] is None
        if not one:
            q, a = words_of(r["question"]), words_of(r["answer"])
        else:
            words = words_of(r["text"])
            cut = len(words) - max(int(len(words) * answer_share), SHINGLE) if len(words) >= 3 * SHINGLE else len(words)
            q, a = words[:cut], words[cut:]
        if q or a:
            out.append((r["item_id"], q, a, one))
    return out


def parts_of(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> list[DataFrame]:
    """The benchmark as one part, or as hashed parts of about most_words words, if it holds more."""
    has = benchmark.columns
    pick = lambda n: (benchmark[n] if n in has else F.lit(None)).cast("string").alias(n if n != text_col else "text")
    rows = benchmark.select(benchmark[id_col].alias("item_id"), pick(text_col), *[pick(n) for n in ("question", "answer")])
    size = rows.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in ("text", "question", "answer")))).first()[0] or 0
    n = -(-size // (5 * most_words)) or 1
    return [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def term_counts(rows: DataFrame) -> DataFrame:
    """term, entries it stands in; under the null term, the number of entries and of their words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            entries = [e for _, q, a, _ in items_of(b.to_pylist()) for e in entries_of(q + a)]
            df = Counter(w for e in entries for w in set(e))
            yield pa.RecordBatch.from_arrays([pa.array([*df, None], pa.string()), pa.array([*df.values(), len(entries)], pa.int64()), pa.array([*[0] * len(df), sum(map(len, entries))], pa.int64())], ["term", "df", "words"])

    return through(rows, run, "term string, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def indexes(benchmark: DataFrame, id_col: str, text_col: str, most_words: int):
    """An index for each part of the benchmark, one at a time."""
    parts = parts_of(benchmark, id_col, text_col, most_words)
    if len(parts) == 1:
        yield Index(items_of(parts[0].collect()))
        return
    whole = cut(term_counts(reduce(DataFrame.unionByName, parts)), "leaks-terms")
    n, total = whole.where("term is null").select("df", "words").first() or (0, 0)
    for part in parts:
        # only the counts of the part's own terms reach the driver
        own = whole.join(term_counts(part).select("term"), "term", "left_semi").select("term", "df").toLocalIterator()
        yield Index(items_of(part.collect()), (n, total, {r.term: r.df for r in own}))


def check(threshold: float) -> None:
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"the threshold must be at least {LEAST_THRESHOLD}")


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_words: int = 2_000_000) -> DataFrame:
    """One row for each document and test item it holds."""
    check(threshold)
    rows, found, kind = id_text(docs, id_col, text_col), None, benchmark.schema[item_col].dataType
    for index in indexes(benchmark, item_col, item_text, most_words):
        box = docs.sparkSession.sparkContext.broadcast(index)
        own = part_leaks(rows, box, threshold, overlap, kind)
        found = own if found is None else found.unionByName(own)
    return found


def part_leaks(rows: DataFrame, box, threshold: float, overlap: float, item_type) -> DataFrame:
    fields = [("doc_id", rows.schema["doc_id"].dataType.simpleString()), ("item_id", item_type.simpleString()), *[tuple(f.split()) for f in OUT.split(", ")]]
    kinds = [to_arrow_type(rows.schema["doc_id"].dataType), to_arrow_type(item_type)]

    def run(batches):
        import pyarrow as pa

        index = box.value
        for b in batches:
            out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for x in index.leaks(words_of(t.as_py()), threshold, overlap)]
            cols = list(zip(*out)) or [[]] * 7
            types = kinds + [pa.float64()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [n for n, _ in fields])

    return through(rows, run, ", ".join(f"{n} {t}" for n, t in fields))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most_words: int = 2_000_000) -> DataFrame:
    """docs without the rows that hold a test item: judged in place, so no text is shuffled."""
    check(threshold)
    kept = docs
    for index in indexes(benchmark, "item_id", "text", most_words):
        box = docs.sparkSession.sparkContext.broadcast(index)
        place = docs.columns.index(text_col)

        def run(batches, box=box):
            import pyarrow as pa

            for b in batches:
                ok = [not box.value.leaks(words_of(t.as_py()), threshold, overlap) for t in b.column(place)]
                yield b.filter(pa.array(ok, pa.bool_()))

        kept = through(kept, run, kept.schema)
    return kept
