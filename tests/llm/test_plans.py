from voxelith.llm import quality


def test_the_filter_stays_above_the_words(docs):
    """Pushed below the projection, the filter would split the text anew for every word."""
    plan = quality.quality_rules(docs)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.index("Filter")
    assert plan.index("split(", top) > top and plan[top : plan.index("\n", top)].count("split(") == 0
