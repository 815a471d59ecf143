from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common
from tidemark.llm.common import Scratch, components, read_table, without
from tests.conftest import DATA


def test_stages_by_hand(spark):
    docs, scratch = read_table(spark, DATA, "documents"), Scratch(spark, "test-pipeline")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_decisions_take_effect_and_odd_rows_pass(spark):
    good = [f"{i} " + " ".join(f"word{(i * 7 + j * j) % 97}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(100, good[0], "en", "s", 0), (101, good[1] + " more", "en", "s", 0), (7, good[7], "en", "s", 0), (None, "z" * 120, None, None, None), (102, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(x for x in kept if x is not None) == [*range(30), 102] and None in kept
    cut = corpus_pipeline.repeats(spark, docs.where("doc_id in (0, 100)"), DATA)
    assert {r.doc_id: r.n_chars for r in cut.collect()} == {0: len(good[0]), 100: 0}
    assert corpus_pipeline.rules(spark, docs.limit(0), DATA).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    kept = corpus_pipeline.classify(spark, docs, "/root/testdata/sf0.01").join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.98 * docs.join(labels, "doc_id").where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.1 * docs.join(labels, "doc_id").where("quality = 0").count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(i, n=60):
    return f"{i} " + " ".join(f"word{(i * 7 + j * j) % 97}x{(i + j) % 41}" for j in range(n))


def test_texts_of_one_key_are_judged_apart(spark):
    """A key on several texts: no text's verdict takes another's row, in any stage."""
    sf = "/root/testdata/sf0.01"
    junk = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels").where("quality = 0"), "doc_id").select("text", "lang").orderBy(F.length("text").desc()).first()
    clean = read_table(spark, sf, "documents").where("length(text) between 500 and 3000").dropDuplicates(["text"])
    rows = [(1, prose(1), "en", "s", 0), (1, prose(2), "en", "s", 0), (1, prose(2), "en", "s", 0), (2, prose(1) + " more", "en", "s", 0), (3, prose(3), "en", "s", 0), (3, "", "en", "s", 0), (None, prose(4), "en", "s", 0), (5, prose(4), "en", "s", 0)]
    few = spark.createDataFrame(rows, COLUMNS)
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, few, sf).collect())
    # key 1 stands on two texts; one of the two near copies of the first text stays, and each other text once
    assert [t for k, t in left if k == 1 and t == prose(2)] == [prose(2)] and sum(t.startswith(prose(1)) for _, t in left) == 1
    assert (3, prose(3)) in left and (3, "") in left and (5, prose(4)) in left and len(left) == 5
    some = clean.orderBy("doc_id").limit(400)
    key = some.first().doc_id
    under = lambda k: some.unionByName(spark.createDataFrame([(k, junk.text, junk.lang, "s", 0)], some.schema))
    other = 10**9
    got, want = ({(r.doc_id, r.text) for r in corpus_pipeline.rules(spark, under(k), sf).collect()} for k in (key, other))
    assert {(other if t == junk.text else k, t) for k, t in got} == want and any(k == key for k, _ in got) and not any(t == junk.text for _, t in got)
    cut = corpus_pipeline.repeats(spark, few, sf)
    assert cut.columns == few.columns and cut.count() == len(rows)
    assert all(r.doc_id == 5 or r.doc_id is None for r in cut.where(F.col("text").startswith("4 ")).collect())
    pieces = corpus_pipeline.packing(spark, few, sf)
    assert pieces.count() >= len(rows)


def test_repeats_of_rows_without_a_key(spark):
    shared = prose(9, 25)
    rows = [(None, "one " + shared, "en", "s", 0), (None, "two " + shared, "en", "s", 0), (None, None, None, None, None)]
    out = [r.text for r in corpus_pipeline.repeats(spark, spark.createDataFrame(rows, COLUMNS), DATA).collect()]
    assert len(out) == 3 and None in out and sum(shared[-100:] in (t or "") for t in out) == 1  # the passage stays once


def test_empty_tables_pass_through_every_stage(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.packing(spark, docs, DATA).count() == 0


def test_rows_without_a_key_are_judged(spark):
    """The same texts with and without keys: what is rejected by its text goes either way, and copies count as copies."""
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents").where("doc_id is not null").dropDuplicates(["text", "lang"])
    bare = docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")
    texts = lambda df: sorted(str((r.text, r.lang)) for r in df.collect())
    stage = corpus_pipeline.rules
    kept = stage(spark, bare, sf)
    assert kept.columns == docs.columns and kept.where("doc_id is not null").count() == 0
    assert texts(kept) == texts(stage(spark, docs, sf)) and 0 < kept.count() < bare.count()
    judged = corpus_pipeline.classify(spark, docs.unionByName(bare.withColumn("source", bare.source)), sf)
    with_key, without_key = (texts(judged.where(x)) for x in ("doc_id is not null", "doc_id is null"))
    assert with_key == without_key and 0 < len(with_key) < docs.count()

    good = [f"{i} " + " ".join(f"word{(i * 7 + j * j) % 97}x{j}" for j in range(40)) for i in range(4)]
    rows = [(1, good[0], "en"), (None, good[0], "en"), (None, good[1], "en"), (None, good[1], "en"), (None, good[1] + " more", "fr"), (None, good[2], None), (None, None, "a"), (None, None, "a"), (None, "", None)]
    few = spark.createDataFrame([(*r, "s", 0) for r in rows], docs.schema)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, few, sf).collect()]
    assert (1, good[0]) in left and (None, good[0]) not in left and (None, good[2]) in left
    assert sum(t is not None and t.startswith(good[1]) for _, t in left) == 1 and sum(not t for _, t in left) == 3 and len(left) == 6


def test_steps_spare_the_driver_what_meets_nothing(spark):
    """No ids: no broadcast and no join. Edges that are stars: the table of the edges and one round, which hashes what it writes."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, t string")
    left = without(rows, "id", spark.createDataFrame([], "id long"))
    assert sorted(r.t for r in left.collect()) == ["a", "b", "c"] and "Join" not in left._jdf.queryExecution().optimizedPlan().toString()

    class Counted(Scratch):
        def table(self, df, name):
            written.append(name)
            return super().table(df, name)

    edges = lambda *e: spark.createDataFrame(list(e), "a long, b long")
    for e, tables, want in (
        ([(5, 2), (7, 2), (9, 4), (9, 4), (3, 3)], 2, {(2, 2), (5, 2), (7, 2), (4, 4), (9, 4)}),
        ([], 1, set()),
        ([(1, 2), (2, 3), (3, 4), (9, 8)], None, {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}),
    ):
        written = []
        assert {tuple(r) for r in components(edges(*e), Counted(spark, "test-stars")).collect()} == want
        assert tables is None or len(written) == tables


def test_the_driver_lets_go_between_tables(spark, monkeypatch):
    """Beyond a share of its heap the driver collects its garbage with each table, below it does not."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    whole = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    scratch, before = Scratch(spark, "test-garbage"), whole()
    for share, more in ((1.0, 0), (0.0, 1), (0.0, 2)):
        monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
        assert scratch.table(spark.range(3), "few").count() == 3
        assert whole() == before + more
