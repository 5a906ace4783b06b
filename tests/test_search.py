"""Searches of a stored index on small rows."""

from cartolode.operators import search
from cartolode.plans import registry

SF = "/root/testdata/sf0.001"


def test_no_pair_of_a_query_and_a_document_is_shuffled(spark):  # F8 F19 F23
    for name in ("bm25", "bm25_boosted"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "item_id" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)


def test_tasks_of_few_documents_and_passes_of_few_terms_find_the_same(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"word{'abcdefg'[(k * j) % 7]}" for j in range(1, 9))) for k in range(60)] + [(60, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "worda wordb"), (2, "wordc"), (3, "wordx"), (4, None)], "item_id long, text string")
    symbols = spark.createDataFrame([(60, "wordx"), (5, "wordc wordc")], "doc_id long, text string")
    index = search.build_index(search.postings(docs), str(tmp_path / "index"))
    run = lambda: sorted(map(tuple, search.bm25(index, queries, top=7, symbols=symbols).collect()))
    want = run()
    assert (3, 60, 2.0, 1) in want and {r[0] for r in want} == {1, 2, 3} and max(r[3] for r in want) == 7
    monkeypatch.setattr(search, "ASKED_TERMS", 1)
    monkeypatch.setattr(search, "SCORED", 3)
    assert run() == want
