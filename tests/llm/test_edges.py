"""Odd tables through the pipeline's stages and the operators: empty, repeated rows, very long texts, clashing names."""

import collections
import hashlib
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from roadtrace.llm import decontam, jaccard, langid, linededup, packing, pii, rans, sharding, simhash, storage, warc
from roadtrace.llm.tokens import WordCachedTokenizer, tokenizer_path

#: Names that the operators use for columns of their own.
CLASHES = ["doc", "kept", "lang_pred", "score", "_h", "_n", "_part", "_text", "key", "hits", "windows", "spans", "n_lines", "shard", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def say(i, n=40):
    return " ".join(f"w{chr(97 + (i * 7 + j * j) % 26)}{chr(97 + (i + j * 3) % 26)}{chr(97 + j % 26)}" for j in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, *["clash"] * len(CLASHES)) for i, t, lang in rows], SCHEMA)


LONG = "\n".join(f"line {i % 500} {say(i % 700, 6)}" for i in range(30_000))  # more than a million characters
ODD = [(i, say(i), "en") for i in range(9)] + [(3, say(3), "en")] * 3 + [(30, None, "en"), (31, "", None), (None, say(60), "en"), (None, None, None), (32, LONG, "en"), (33, "12 !", "en")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    table(spark, ODD).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, say(5, 20)), (None, "zz zz"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = [r for r in ODD if r[1] and r[0] != 33]
    one = p.language_id(spark, docs, folder)
    assert one.columns == docs.columns and collections.Counter((r["doc_id"], r["text"]) for r in one.collect()) == collections.Counter(r[:2] for r in clean)
    assert one.where("doc <> 'clash' or score <> 'clash' or _h <> 'clash'").isEmpty()
    two = p.line_dedup(spark, docs, folder)
    assert two.columns == docs.columns and collections.Counter(r["doc_id"] for r in two.collect()) == collections.Counter(r[0] for r in ODD)
    three = p.near_duplicates(spark, docs, folder)
    assert three.columns == docs.columns and collections.Counter(r["doc_id"] for r in three.collect()) == collections.Counter({None: 2}) + collections.Counter({r[0] for r in ODD if r[0] is not None})
    four = p.decontamination(spark, docs, folder)
    assert four.columns == docs.columns and sorted(str(r["doc_id"]) for r in four.collect()) == sorted(str(r[0]) for r in ODD if r[0] != 5)
    five = p.best_fit_packing(spark, docs, folder)
    assert collections.Counter(r["doc_id"] for r in five.where("piece = 0").collect()) == collections.Counter(r[0] for r in ODD)


@pytest.mark.parametrize("stage", [s for s, _ in p.STAGES])
def test_stages_on_an_empty_table(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    out = dict(p.STAGES)[stage](spark, docs, folder)
    assert out.count() == 0 and (stage == p.STAGES[-1][0] or out.columns == docs.columns)


def test_run_clears_up(spark, folder):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    rows = p.run(spark, folder).count()
    left = set(os.listdir(base)) - before
    assert rows >= 9 and len(left) == 1 and next(iter(left)).startswith("stage-")


def test_scratch_and_release(spark):
    kept = storage.shared_folder(spark, "kept")
    spark.range(3).write.parquet(kept)
    with storage.scratch():
        inner = storage.materialize(spark.range(5), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and spark.read.parquet(kept).count() == 3
    storage.release([kept])
    assert not os.path.exists(kept.removeprefix("file://"))


def test_small_batches_only_lowers(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    for before, after in ((10_000, storage.BATCH_ROWS), (0, storage.BATCH_ROWS), (50, 50)):
        spark.conf.set(name, str(before))
        storage.small_batches(spark)
        assert spark.conf.get(name) == str(after)
    spark.conf.set(name, old)


# --- very long texts: one of more than a million characters beside short ones


@pytest.fixture(scope="module")
def long_docs(spark):
    return table(spark, [(1, LONG, "en"), (2, LONG, "en"), (3, say(3), "en")])


def test_long_text_token_file_and_pack(long_docs):
    t = WordCachedTokenizer(tokenizer_path())
    n = len(t.tokenizer.encode(LONG, add_special_tokens=False).ids) + 1
    assert {(r["doc_id"], r["n_tokens"]) for r in rans.token_binary(long_docs).collect()} >= {(1, n), (2, n)}
    got = packing.pack(long_docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {(r["doc_id"], r["n"]) for r in got} >= {(1, n), (2, n)} and max(r["most"] for r in got) == 4096


def test_long_text_warc(spark):
    df = spark.createDataFrame([(1, "u", LONG), (2, "v", LONG), (3, "w", "x")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(df).collect()}
    assert got[1]["refers_to"] == 2 and got[2]["payload_bytes"] == len(LONG) and got[3]["record_type"] == "response"


def test_long_text_of_many_lines(spark):
    """200,000 lines, every other one common: linear in the lines."""
    lines = [f"only here {i}" if i % 2 else f"shared {i % 50}" for i in range(200_000)]
    rows = [(0, "\n".join(lines), "en")] + [(i, "\n".join(f"shared {j}" for j in range(0, 50, 2)), "en") for i in range(1, 11)]
    got = linededup.drop_repeated_lines(table(spark, rows)).where("doc.doc_id = 0").head()
    assert (got["n_lines"], got["n_dropped"]) == (200_000, 100_000) and got["kept"] == "\n".join(lines[1::2])


def test_counts_decide_in_the_probe(spark):
    """An index of all keys of two documents and more: those under the limit are found and stay."""
    rows = [(i, f"two {i // 2}\nall\nthree {i // 3}", "en") for i in range(12)]
    for index_from in (2, 3):
        got = {r["doc"]["doc_id"]: r["kept"] for r in linededup.drop_repeated_lines(table(spark, rows), min_docs=3, index_from=index_from).collect()}
        assert got == {i: f"two {i // 2}" for i, _, _ in rows}


def test_counts_are_compact_and_exact():
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"key": rng.integers(0, 2**63, 3000), "print": rng.integers(0, 2**63, 3000), "n": rng.integers(2, 200_000, 3000)})
    h = linededup.PerfectHash.build(frame["key"].to_numpy().view(np.uint64))
    at = h.find(frame["key"].to_numpy().view(np.uint64))
    prints, n = np.zeros(3000, np.uint64), np.zeros(3000, "<u2")
    prints[at], n[at] = frame["print"].to_numpy().view(np.uint64), np.minimum(frame["n"], linededup.MOST)
    low, high = linededup._pack(prints)
    shard = linededup.Shard({"bits": b"".join(w.tobytes() for w in h.levels), "sizes": [len(w) for w in h.levels], "low": low, "high": high, "counts": n.tobytes(), "spare": b""})
    keys = np.concatenate([frame["key"].to_numpy().view(np.uint64), rng.integers(0, 2**63, 3000, np.uint64)])
    own = np.concatenate([frame["print"].to_numpy().view(np.uint64), rng.integers(0, 2**63, 3000, np.uint64)])
    assert shard.counts(keys, own).tolist() == np.minimum(frame["n"], linededup.MOST).tolist() + [0] * 3000


def test_long_text_contamination(spark, long_docs):
    words = LONG.split()
    bench = spark.createDataFrame([(4, " ".join(words[90_000:90_020])), (5, "nowhere " * 13)], "item_id long, text string")
    got = {r["doc"]["doc_id"]: r for r in decontam.contamination(long_docs, bench).collect()}
    assert got[1]["items"] == [4] and got[1]["n_words"] == len(words) and got[3]["n_items"] == 0


def test_one_window_in_very_many_items(spark):
    """A header of 13 words in 50,000 items, and documents that hold it."""
    header = say(77, 13)
    bench = spark.range(50_000).select(F.col("id").alias("item_id"), F.concat(F.lit(header + " q"), F.col("id")).alias("text"))
    docs = table(spark, [(i, f"{say(i, 5)} {header} {'q7' if i == 4 else 'x'}", "en") for i in range(6)])
    got = {r["doc_id"]: r for r in decontam.summary(decontam.contamination(docs, bench, max_windows=40_000)).collect()}
    want = hashlib.sha256(",".join(sorted(map(str, range(50_000)))).encode()).hexdigest()
    assert {r["n_items"] for r in got.values()} == {50_000} and {r["items_sha256"] for r in got.values()} == {want}
    assert got[4]["n_hit"] == 14 and got[3]["n_hit"] == 13


def test_long_text_fingerprints_and_links(long_docs):
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(long_docs).collect()}
    assert got[1]["fp"] == got[2]["fp"] and got[1]["near_next"] == 1.0 and got[1]["n_chars"] == len(LONG)
    linked = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_join(long_docs).collect()}
    assert linked == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_links_of_rows_without_an_id(spark):
    rows = [(None, say(1)), (4, say(1)), (None, say(2)), (9, say(2) + " tail"), (None, None)]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard.similarity_join(table(spark, [(*r, "en") for r in rows])).collect())
    assert got == [("4", "4", 1), ("9", "9", 1), ("None", "4", 1), ("None", "9", 1), ("None", "None", 0)]


def test_long_text_and_repeated_ids_in_shards(spark, long_docs):
    got = {r["doc"]["doc_id"]: r["shard_bytes"] for r in sharding.shard_documents(long_docs).collect()}
    assert got[1] >= len(LONG) and got[3] < 1 << 20
    rows = [(7, "same " * 10, "en")] * 300 + [(7, f"text {i} " * (1 + i % 9), "en") for i in range(300)] + [(7, "large " * 200, "en")] * 3 + [(7, None, "en")] * 20
    seen = [collections.Counter((r["doc"]["text"], r["shard"], r["shard_bytes"]) for r in sharding.shard_documents(table(spark, rows).repartition(n), limit=900).collect()) for n in (1, 6)]
    assert seen[0] == seen[1] and sum(seen[0].values()) == len(rows)
    total, n = collections.Counter(), collections.Counter()
    for (text, shard, _), m in seen[0].items():
        total[shard] += m * len(text or "")
        n[shard] += m
    assert all(total[s] == b and (b <= 900 or n[s] == 1) for (_, s, b) in seen[0])


def test_fold_takes_the_shortest_prefix_that_fits():
    rng = np.random.default_rng(8)
    for _ in range(50):
        cells = np.unique(rng.integers(0, 64, 30))
        size = rng.integers(0, 40, len(cells))
        leaves, root = sharding.fold(cells, size, 6, 0, 60)
        fits = lambda d, c: size[cells >> (6 - d) == c >> (6 - d)].sum() <= 60
        want = {c: next((d for d in range(7) if fits(d, c)), None) for c in cells.tolist()}
        got = {c: d for c in cells.tolist() for d, x, _ in [*leaves, *([(0, 0, 0)] if root else [])] if c >> (6 - d) == x}
        assert got == {c: d for c, d in want.items() if d is not None}


def test_language_of_a_long_unknown_word():
    """Large counts: a word outside the vocabulary keeps its score for both languages, and they differ."""
    model = langid.fit(pd.DataFrame({"lang": ["a", "b"], "word": ["the", "und"], "n": [5 * 10**11, 5 * 10**6]}), {"a": 0.5, "b": 0.5})
    logs, n = langid.Scorer(model).log_probs(["ጀ" * 47, "ጀ" * 2000])
    p = model["prob"][len(model["pieces"]) + 1]
    mark = np.log(model["prob"][model["pieces"].index("▁")])
    assert np.allclose(logs[0], mark + 47 * np.log(p), rtol=1e-6) and np.allclose(logs[1], mark + 2000 * np.log(p), rtol=1e-6) and n.tolist() == [1, 1]
    assert (logs[0] < -900).all() and abs(logs[0, 0] - logs[0, 1]) > 100


def test_recall_of_planted_personal_data():
    """Base and added kinds planted in plain sentences: nine in ten at least are found, and the sentences alone have none."""
    rng = np.random.default_rng(11)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def luhn(n):
        body = digits(n - 1)
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))

    def iban():
        body = digits(18)
        return next(f"DE{c:02d}{body}" for c in range(2, 99) if pii.mod97(f"DE{c:02d}{body}"))

    token = lambda n: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    planted = {
        "email": lambda: f"a{digits(3)}@mail{digits(1)}.example.com", "ip": lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)), "card": lambda: luhn(16),
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "iban": iban, "card_short": lambda: f"my card {luhn(15)}",
        "secret": lambda: [f'token = "{rng.bytes(20).hex()}"', f"export AWS=AKIA{token(16).upper()}", f"password: {token(24)}", f"ghp_{token(36)}", token(40)][rng.integers(5)],
    }
    for kind, make in planted.items():
        texts = [f"{say(i, 8)} {make()} {say(i + 1, 8)}." for i in range(200)]
        assert sum(any(s[0] == kind for s in pii.spans_of(t)) for t in texts) >= 180, kind
    clean = [say(i, 30) for i in range(300)] + ["chapter-2-of-some-long-title-in-an-address-2021", "MyLongCamelCaseIdentifier2VersionName", "https://example.com/Some-Long-Title-Of-Page-2021-With-Words", "order 1234567890123456 of 2021-04-05", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4"]
    assert not [t for t in clean if pii.spans_of(t)]


def test_alike_pieces_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 40)
    got = packing.pack(table(spark, [(1, say(1), "en")] * 150 + [(None, None, None)] * 90)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= packing.CAPACITY
    total = sum(r["length"] for r in got)
    assert len(got) == 240 and len(by) == -(-total // packing.CAPACITY)
