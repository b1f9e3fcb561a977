from catchwork.llm.phrases import _fine_calls


def joined_rows(plan):
    """Rows that the joins of an executed plan have made."""
    name, children = plan.nodeName(), plan.children()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else None
    below = [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    return own + sum(map(joined_rows, below))


def test_a_run_of_many_documents_meets_its_passage_once_a_block(spark):
    """On check_h the runs of one passage, one a document, made 594558 rows in a join by phrase before they were made distinct."""
    runs = spark.range(5000).selectExpr("int(id % 2) AS block", "7L AS phrase", "8L AS fine")
    windows = spark.createDataFrame([(1, 7, 9), (0, 7, 10), (0, 6, 9)], "block int, phrase long, fine long")
    passages = spark.createDataFrame([(0, 7, 8), (1, 7, 9), (2, 5, 8)], "id long, phrase long, fine long")
    calls = _fine_calls(runs, windows, passages)
    assert sorted(map(tuple, calls.collect())) == [(0, 0), (1, 0), (1, 1)]
    assert 3 <= joined_rows(calls._jdf.queryExecution().executedPlan()) <= 10
