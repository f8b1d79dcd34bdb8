from pyspark.sql import functions as F

from cragline.llm.line_dedup import dedup_lines, line_decisions


def test_texts_that_lose_no_line_are_not_shuffled(spark):
    same = [(i, "a line that many documents have\n" + f"own{chr(97 + i)} words here", "kept") for i in range(4)]
    docs = spark.createDataFrame(same + [(9, "nothing of this recurs at all", "other"), (10, None, None)], "doc_id long, text string, _word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_lines(docs)
        parts = out.withColumn("at", F.spark_partition_id()).collect()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: (r.n_lines, r.n_dropped, r._word) for r in parts} == {0: (2, 0, "kept"), 1: (2, 1, "kept"), 2: (2, 1, "kept"), 3: (2, 1, "kept"), 9: (1, 0, "other"), 10: (0, 0, None)}
    assert plan.startswith("Union")  # one side without a join by document


def test_lines_without_a_template_are_left_out_before_the_join(spark):
    docs = spark.createDataFrame([(i, f"a line that many documents have\nown{chr(97 + i)} words here too") for i in range(4)], "doc_id long, text string")
    out = line_decisions(docs, short_docs=3)
    assert {r._id: r["drop"] for r in out.collect()} == {1: [0], 2: [0], 3: [0]}
    assert "bitmap" in out._jdf.queryExecution().optimizedPlan().toString().lower()
