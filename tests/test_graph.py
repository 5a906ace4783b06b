"""Cycles on small graphs."""

from cartolode.operators import graph
from cartolode.plans import reviews


def test_rounds_of_cycles_send_no_side_of_a_join_through_the_driver(spark, monkeypatch):  # F22
    plans, write = [], graph.save

    def save(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(graph, "save", save)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src long, dst long")
    assert sorted(map(tuple, graph.cycles(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_the_view_of_couplings_tells_edges_once(spark, monkeypatch):  # F18
    asked, view = [], reviews.V
    monkeypatch.setattr(reviews, "V", lambda s, d, name: asked.append(name) or view(s, d, name))
    reviews.QUERIES["coupling_view"](spark, "/root/testdata/sf0.001")
    assert asked == ["edges"]
