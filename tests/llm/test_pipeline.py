import corpus_pipeline
from quillon.llm import decontaminate, jaccard
from quillon.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], docs
    assert len(names) == len(set(names)) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.persist()
        kept = stage(spark, kept, SF)
        if k < 4:
            assert kept.columns == docs.columns
        if k == 1:
            found = jaccard.join(kept)
            assert found.where("component_id <> doc_id").count() == 0 and kept.count() < before.count()
        if k == 2:
            assert decontaminate.find(kept, table(spark, SF, "benchmark")).count() == 0
        if k == 3:
            assert kept.count() == before.count() and kept.where("n_chars <> length(text)").count() == 0
    assert {r["doc_id"] for r in kept.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in every column, repeated rows, a long text and a column of a clashing name."""
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    rows = [(0, None, None, None, None, 1), (1, "", "en", None, 0, 1), (2, "same text here again now", "en", "s", 24, 1), (2, "same text here again now", "en", "s", 24, 1), (3, long, None, "s", len(long), 1), (None, "no id", None, None, None, 1), (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3"', "en", "s", 1, 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _spans int")
    for name, stage in corpus_pipeline.STAGES:
        kept, nothing = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
        assert nothing.count() == 0
        if name != "packing":
            assert kept.columns == odd.columns
            ids = sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.select("doc_id").collect())
            assert [i for _, i in ids] == [None, 0, 1, 2, *[2] * (name != "ngram_jaccard_join"), 3, 4]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0 and rows.where("offset + length > 2048").count() == 0


def test_stages_begin_with_heaps_given_back(spark):
    """A full collection in the executors' JVM, here the session's own, before each stage."""
    docs, beans = table(spark, SF, "documents").limit(0), spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = [b for b in beans if any(x in b.getName() for x in ("Old Gen", "MarkSweep"))]
    for name, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in full)
        assert stage(spark, docs, SF).count() == 0
        assert sum(b.getCollectionCount() for b in full) > before, name
