"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with a bounded sample of its
texts. A text is encoded once with each dictionary and gets the language of the smallest encoding;
narrow margins are marked as rejected.

Defined cases: null texts and texts without a letter get `und` and score 0; whole texts are
encoded, in pieces; ties go to the language commonest in learning; rows repeat as they are; an empty table
gives no rows; without any learned language every text gets `und`. Columns other than the id, the
text and (in fit) the language are never looked at.
"""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import id_text, through

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}]+")
OUT = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def plain(text: str) -> bytes:
    """Lower-case letters, runs of anything else as one space: junk costs no language anything."""
    return OTHER.sub(" ", text.lower()).strip().encode()


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 60, dict_bytes: int = 32_000, most_chars: int = 20_000, most_langs: int = 1000) -> dict[str, bytes]:
    """Dictionary content for each language (the documented bounds: `per_lang` texts of up to
    `most_chars` characters, `dict_bytes` bytes, the `most_langs` commonest languages).

    The rank within a language is limited on each task before rows are moved.
    """
    rows = id_text(docs, id_col, text_col, lang=docs[lang_col]).where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= most_chars))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    kept = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_lang).join(F.broadcast(top.select("lang")), "lang", "left_semi")
    found: dict[str, list] = {}
    for r in kept.select("lang", "rank", "text").toLocalIterator():
        found.setdefault(r.lang, []).append((r["rank"], plain(r.text)))
    dicts = {}
    for lang in [r.lang for r in top.collect() if r.lang in found]:
        texts = found[lang]
        share = max(1, dict_bytes // len(texts))
        texts = [t for _, t in sorted(texts)]
        short = [t for t in texts if len(t) <= share]
        share = max(share, (dict_bytes - sum(map(len, short))) // max(1, len(texts) - len(short)))
        dicts[lang] = b" ".join(t[:share] for t in texts)[-dict_bytes:]
    return dicts


class Classifier:
    """Smallest encoding wins. Pieces of `piece` bytes keep the dictionary in reach of the whole text;
    texts of under `short` bytes are encoded at the highest level, where a byte counts."""

    def __init__(self, dicts: dict[str, bytes], level: int = 6, piece: int = 4096, short: int = 512):
        self.piece, self.short, self.langs = piece, short, list(dicts)
        self.coders, self.close = ([self._coder(dicts[x], n) for x in self.langs] for n in (level, 19))

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def classify(self, text: str | None, narrow: float) -> tuple[str, float, float, bool]:
        """lang, score, margin (share by which the second encoding is larger), rejected."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0, True
        data = plain(text)
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in (self.close if len(data) < self.short else self.coders)]
        best = min(sizes)
        at = sizes.index(best)
        rest = sizes[:at] + sizes[at + 1 :]
        margin = (min(rest) - best) / min(rest) if rest else 1.0
        # bits saved against each other language, per 8 bytes of text, as a soft share
        scale = 8.0 / math.sqrt(len(data) + 8.0)
        return self.langs[at], 1.0 / sum(math.exp(-min(50.0, (s - best) * scale)) for s in sizes), margin, margin < narrow


def predict(docs: DataFrame, dicts: dict[str, bytes], held_out: Column, id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.02, level: int = 6) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row of docs."""
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", held_out.alias("held_out"))
    box = docs.sparkSession.sparkContext.broadcast(dicts)

    def run(batches):
        import pyarrow as pa

        model = Classifier(box.value, level)
        for b in batches:
            got = [model.classify(t.as_py(), narrow) for t in b.column(1)]
            cols = list(zip(*got)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return through(rows, run, OUT)
