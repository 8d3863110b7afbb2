"""Links proposed between near copies: a forest is compared by exact sets, the components stay."""

from itertools import combinations

from aerolake.llm import graph, simhash


def test_of_proposed_links_a_forest_is_compared(spark):
    words = " ".join(f"w{k}" for k in range(200))
    texts = spark.createDataFrame([(i, f"{words} v{i}") for i in range(40)], "node long, text string")
    pairs = spark.createDataFrame(list(combinations(range(40), 2)), "a long, b long").coalesce(1)
    found = simhash._confirmed(pairs, texts)
    assert found.count() == 39
    assert {r.root for r in graph.components(found).collect()} == {0}
