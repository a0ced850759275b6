"""Sets built from whole columns, whatever the ids."""

from roadtrace.queries import QUERIES


def test_a_source_on_odd_ids_only_is_in_both_sides(spark, tmp_path):
    spark.createDataFrame([(1, "de", "odd"), (3, "es", "odd"), (2, "de", "even"), (5, "es", "src2")], "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "http://odd/a"), (2, "https://src2/b?x"), (3, "http://host/")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r["name"] for r in QUERIES["u2_feature_overlap_whole"](spark, str(tmp_path)).collect()] == ["odd"]
    got = {(r["k"], r["side"]) for r in QUERIES["j11_unpaired_files_whole"](spark, str(tmp_path)).collect()}
    assert got == {("even", "phone"), ("host", "vehicle")}
