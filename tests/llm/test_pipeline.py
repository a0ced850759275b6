"""The pipeline's stages on a small table: each against its operator's brute force, and the whole."""

import collections

import pytest

import corpus_pipeline as p
from roadtrace.llm.tokens import WordCachedTokenizer, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    say = lambda i: " ".join(f"w{chr(97 + (i * 7 + j * j) % 26)}{chr(97 + (i + j * 3) % 26)}{chr(97 + j % 26)}" for j in range(40))
    rows = [(i, say(i) + "\nShared footer line", "en", "s", 0) for i in range(12)]
    rows += [(20, say(3) + "\nshared footer LINE ", "en", "s", 0), (21, "12 34", "en", "s", 0), (22, None, "en", "s", 0), (23, say(50), "en", "s", 0), (24, say(51), None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(say(50).split()[:20]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_stages(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = p.language_id(spark, docs, d)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {r[0] for r in rows} - {21, 22}
    two = p.line_dedup(spark, one, d).collect()
    assert all("ooter" not in r["text"] and r["n_chars"] == len(r["text"]) for r in two) and len(two) == len(rows) - 2
    three = p.near_duplicates(spark, spark.createDataFrame(two, SCHEMA), d)
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two} - {20}
    four = p.decontamination(spark, three, d)
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()} - {23}


def test_run(spark, tables):
    d, _ = tables
    got = p.run(spark, d).collect()
    t = WordCachedTokenizer(tokenizer_path())
    n = collections.Counter()
    for r in got:
        n[r["doc_id"]] += r["length"]
    assert set(n) == {*range(12), 24} and [s[0] for s in p.STAGES] and len(p.STAGES) == 5
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert all(n[i] == len(t.encode([texts[i].split("\n")[0]])[0]) + 1 for i in n)


def test_registered_queries_are_the_ten_and_the_pipeline():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
