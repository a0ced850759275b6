"""Near copies whose rows have no id are linked like any others."""

from roadtrace.llm import jaccard


def test_classes_without_an_id_keep_their_links(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:-i], *(f"x{i}{j}" for j in range(i))] if i else words) for i in range(4)]
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (9, "nothing like the others at all here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similarity_join(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_links"] for i in (1, 7, 9)] == [4, 4, 0] and [by[i]["class_id"] for i in (1, 7, 9)] == [1, 1, 9]
    nameless = sorted((r["n_links"], r["class_id"] or 0) for r in got if r["doc_id"] is None)
    assert nameless == [(0, 0), (4, 1), (4, 1), (4, 1)]
