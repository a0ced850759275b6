"""Ranges of rows: whole, in order, and the same whatever the partitions."""

import collections
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import ranges, rans, simhash, storage, warc

SCHEMA = "page_id long, url string, html string, _part string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def dealt(df, per_part, tails=False):
    df = df.select("page_id", "url", "html")
    found = ranges.cut(df, "page_id", ["url", "html"], F.octet_length("html"), per_part)
    return ranges.deal(df, found, "page_id", ["url", "html"], tails).withColumn("_at", F.spark_partition_id()).collect()


ROWS = {
    "even": [(i, f"u{i}", "x" * (i % 90)) for i in range(600)],
    "one id": [(7, f"u{i}", f"text {i}") for i in range(500)],
    "null ids": [(None, f"u{i}", f"text {i}") for i in range(500)] + [(-(2**63), "least", "y")],
    "alike": [(5, "u", "same " * 20)] * 400 + [(i, "v", "z") for i in range(50)],
    "large": [(1, "u", "l" * 50_000), (2, "u", None), (3, None, "s")],
    "none": [],
}


@pytest.mark.parametrize("kind", ROWS)
def test_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(ranges, "MAX_TASKS", 7)
    rows = ROWS[kind]
    got = {n: dealt(pages(spark, rows).repartition(n), 2000) for n in (1, 5)}
    keyed = {n: sorted((r["_part"], r["page_id"] is not None, r["page_id"] or 0, r["url"] or "", r["html"] or "", r["_n"]) for r in own) for n, own in got.items()}
    assert keyed[1] == keyed[5]
    assert sum((collections.Counter({(r["page_id"], r["url"], r["html"]): r["_n"]}) for r in got[1]), collections.Counter()) == collections.Counter(rows)
    parts = collections.defaultdict(list)
    for r in got[1]:
        parts[r["_part"]].append(r)
    assert sorted(parts) == list(range(len(parts)))
    ids = [i for p in sorted(parts) for i in sorted((r["page_id"] is not None, r["page_id"] or 0) for r in parts[p])]
    assert ids == sorted(ids)
    for own in parts.values():  # bounded, unless a single row is larger
        assert len({r["_at"] for r in own}) == 1 and (sum(r["_n"] * (len(r["html"] or "") + 64) for r in own) <= 3 * 2000 or len(own) == 1 or kind == "large")


def test_wide_ids_in_token_files():
    ids = np.array([1, 70_000, 200_000, 65_536, 1], np.uint32)
    assert (rans.TokenFile(rans.encode_file(ids, [3], np.array([5]))).ids() == ids).all()


def test_find_is_a_search_over_both_keys():
    rng = np.random.default_rng(3)
    bounds = pd.DataFrame({"k": np.sort(rng.integers(0, 6, 12)), "h": rng.integers(-9, 9, 12), "copies": 0, "width": 1}).drop_duplicates(["k", "h"]).sort_values(["k", "h"])
    r = ranges.Ranges(bounds)
    k, h = rng.integers(0, 7, 300), rng.integers(-10, 10, 300)
    pairs = list(zip(r.ids.tolist(), r.hashes.tolist(), strict=True))
    assert r.find(k, h).tolist() == [max(0, sum(p <= q for p in pairs) - 1) for q in zip(k.tolist(), h.tolist(), strict=True)]


@pytest.mark.parametrize("ids", ["one", "null", "alike"])
def test_ten_thousand_rows_of_one_id(spark, ids):
    rows = [(None if ids == "null" else 9, f"w{i}" if ids != "alike" else "same words") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = rans.write_token_files(df, storage.shared_folder(spark, "t"), per_file=50_000)
    files = manifest.collect()
    assert sum(r["n_docs"] for r in files) == 10_000 and len(files) >= 10 and max(r["n_docs"] for r in files) < 2000
    read = rans.read_token_files(manifest).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in read)
    assert [s for s, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n in starts])[:-1]]).tolist()
    got = simhash.edited_fingerprints(df, per_task=50_000).collect()
    assert len(got) == 10_000 and (ids != "alike" or {r["near_next"] for r in got} == {1.0})


def test_next_row_of_all_rows(spark, monkeypatch):
    """The edited texts of distinct ids over many small ranges, some to a task, by hand."""
    monkeypatch.setattr(ranges, "MAX_TASKS", 3)
    rows = [(3 * i, f"text number {i} " * (1 + i % 5)) for i in range(300)]
    got = {r["doc_id"]: r["edited_sha256"] for r in simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_task=700).collect()}
    for (i, t), (_, x) in zip(rows, [*rows[1:], rows[0]], strict=True):
        q = len(t) // 4
        assert got[i] == hashlib.sha256((t[: len(t) - q] + x[:q]).encode()).hexdigest()


def test_archives_are_the_same_on_any_partitions(spark):
    """2,600 pages over several partitionings and numbers of partitions: the same file names and bytes."""
    rows = [(i, f"http://x/{i}", f"<p>{i * i % 977} {'body ' * (i % 40)}</p>") for i in range(2600)]
    seen = []
    for n, shuffle in ((1, "3"), (7, "8"), (4, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        df = pages(spark, rows if n % 2 else rows[::-1]).repartition(n)
        manifest = warc.write_warc(df, storage.shared_folder(spark, "w"), roll_bytes=20_000, per_task=60_000).collect()
        seen.append({r["file"].rsplit("/", 1)[1]: warc.read_file(r["file"]) for r in manifest})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 5
