"""One test per finding of the round that changed code."""

from pyspark.sql import functions as F

from tierlens import constants as C
from tierlens.operators import corpus as D
from tierlens.operators import training as TR
from tierlens.session import scratch_path

LABELLED = "tier_label int, template_idx int, doc_id long, prompt string, " + ", ".join(f"{c} int" for c in D.FEATURES)


def labelled(label, template, doc, n):
    return (label, template, doc, f"{n}" * 150, n, n + 1, n + 2, n + 3, n + 4)


def test_f3_first_samples_of_null_and_equal_keys(spark):
    rows = [labelled(1, 2, 5, 1), labelled(1, 2, None, 2), labelled(1, 3, 1, 3), labelled(2, 0, 9, 4), labelled(2, 0, 7, 5), labelled(2, 0, 7, 5),
            labelled(None, None, 3, 6), labelled(None, 1, 1, 7), labelled(3, 1, None, 8), labelled(3, 0, 2, 9)]
    got = {r.tier_label: tuple(r)[1:] for r in D.first_sample_per_label(spark.createDataFrame(rows, LABELLED)).collect()}
    assert got == {x: ((f"{n}" * 150)[:110], n, n + 1, n + 2, n + 3, n + 4) for x, n in ((1, 2), (2, 5), (None, 6), (3, 9))}
    assert D.first_sample_per_label(spark.createDataFrame([], LABELLED)).collect() == []
    many = [labelled(x, t, x, t) for x in range(150) for t in (4, 3, 5)]
    assert {(r.tier_label, r.token_count) for r in D.first_sample_per_label(spark.createDataFrame(many, LABELLED)).collect()} == {(x, 3) for x in range(150)}


def test_f3_no_prompt_is_sorted_for_the_first_samples(spark):
    """Only rows at the least keys reach the aggregate that sorts: the scan keeps out other documents."""
    path = scratch_path(spark, "f3")
    spark.createDataFrame([(i, f"text {i}", "s") for i in range(50)], "doc_id long, text string, source string").write.parquet(path)
    out = D.first_sample_per_label(D.labelled_corpus(spark.read.parquet(path)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,0)" in plan.split("PushedFilters:")[1].split("]")[0]
    firsts = {tier: text for tier, text, *_ in reversed(C.CORPUS_TEMPLATES)}
    got = {r.tier_label: r.prompt_preview for r in out.collect()}
    assert got == {tier: (text.replace("{data}", "text 0") + C.CORPUS_SUFFIX_BEFORE + "s" + C.CORPUS_SUFFIX_AFTER)[:110] for tier, text in firsts.items()}


def test_f1_f2_f4_f5_the_fit_gets_equal_parts_of_a_small_file(spark):
    """A matrix takes a few bytes a row: as one file it was one task, whatever its number of rows."""
    n = 300_000
    rows = spark.range(n).select(*[(F.col("id") % (7 + i)).cast("int").alias(c) for i, c in enumerate(C.FEATURE_COLUMNS)],
                                 (1 + F.col("id") % 3).cast("int").alias("tier_label"), (F.col("id") % 5 == 0).alias("is_test"))
    matrix, counts = TR.written_matrix(rows.coalesce(1), "tier_label", "f1", ~F.col("is_test"))
    assert counts == {1: 80_000, 2: 80_000, 3: 80_000}
    parts = [r.n for r in matrix.where("NOT is_test").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) >= 2 and max(parts) < 0.6 * sum(parts) and sum(parts) == 240_000
    assert matrix.exceptAll(rows).isEmpty() and matrix.count() == n


def test_f1_parts_follow_from_rows_and_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(100, numPartitions=3)
    assert TR.dealt(few, 100, 1000).rdd.getNumPartitions() == 3                  # left as it is
    assert TR.dealt(few, 100, 100).rdd.getNumPartitions() == max(1, min(cores, 4))
    assert TR.dealt(few, 100, 1).rdd.getNumPartitions() == 100
