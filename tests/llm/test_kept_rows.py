"""Quality rules without the rows in Python."""

from strucreg.llm import quality


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_rows_stay_out_of_python(spark):
    words = "the old house by the river was sold to a young family that came from the north of the country last year"
    rows = [(1, words, "en", "x"), (None, None, None, "y"), (1, "spam " * 60, "en", "z"), (2, words + " and stays", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, more string")
    kept = quality.keep_good(docs)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((rows[0], rows[3]), key=str)
    # only the two histograms go to Python, not the rows
    assert "MapInArrow" not in _plan(kept) and _plan(kept).count("ArrowEvalPython") == 1
