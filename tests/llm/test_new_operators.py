"""Collocations, URL filters and the filter audit against brute force, on odd tables and hot groups."""

import collections
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import audit, collocations, queries, storage, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, c string, _key string, words string, page string, host string, rule string"
CLASH = ["clash"] * 7


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, *CLASH) for i, t, lang, src in rows], SCHEMA)


# --- collocations


def brute_collocations(rows, max_words=3, least=10, percent=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    frequent = {x: a for x, a in f.items() if a >= least}
    holders = collections.defaultdict(int)
    for (lang, x), a in frequent.items():
        for k in range(2, len(x)):
            for i in range(len(x) - k + 1):
                holders[lang, x[i : i + k]] = max(holders[lang, x[i : i + k]], a)
    for (lang, x), a in frequent.items():
        if len(x) > 1 and not 100 * holders[lang, x] >= percent * a:
            cuts = [(1000000 * a * a // (f[lang, x[:k]] * f[lang, x[k:]]), k) for k in range(1, len(x))]
            score, k = min(cuts)
            out.append((lang, " ".join(x), a, f[lang, x[:k]], f[lang, x[k:]], n[lang], score))
    ranked = []
    for lang, own in itertools.groupby(sorted(out), key=lambda r: r[0]):
        own = sorted(own, key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return ranked


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "a\x01b", "é", "new", "york", "city", "a", "b", "hot", "\U0001f600"]
    marks = [" "] * 8 + ["\t", "  ", ", ", ".\n", "\r", ":"]
    return "".join(words[i] + marks[j] for i, j in zip(rng.zipf(1.4, n) % len(words), rng.integers(0, len(marks), n), strict=True))


ROWS = [(i, prose(i, 120), ["en", "fr", None][i % 3], "s") for i in range(30)] + [(50, None, "en", "s"), (51, "", None, "s"), (None, " . ,", "xx", "s"), (52, "new york city " * 20_000, "en", None)] + [(7, prose(7, 120), "en", "s")] * 3


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_collocations_are_those_of_brute_force_whatever_the_ranges(spark, ranges):
    """With many ranges most begin below a frequent word or pair, and some hold nothing else."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in collocations.collocations(docs(spark, ROWS).repartition(5)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_collocations(ROWS)
    assert sorted(got) == sorted(want) and len(want) > 60


@pytest.mark.parametrize("limits", [(4, 3, 80, 25), (2, 1, 50, 2000), (3, 1, 1000, 7)])
def test_collocations_with_other_limits(spark, limits, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED", 2)  # ranked in parts
    monkeypatch.setattr(collocations, "HELD_TOKENS", 50)
    monkeypatch.setattr(collocations, "BATCH_RUNS", 9)
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)  # lets most runs through
    max_words, least, percent, top = limits
    got = [tuple(r) for r in collocations.collocations(docs(spark, ROWS[:34]), max_words, least, percent, top).collect()]
    assert sorted(got) == sorted(brute_collocations(ROWS[:34], max_words, least, percent, top))


def test_extension_of_a_hot_pair_over_small_batches(spark):
    """A pair with hundreds of extensions, cut into batches of three rows."""
    rows = [(i, " ".join(["hot pair"] * 2 + [f"x{i}"]), "en", "s") for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in collocations.collocations(docs(spark, rows), min_count=1, top=5000).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(storage.BATCH_ROWS))
    assert sorted(got) == sorted(brute_collocations(rows, least=1, top=5000))


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    huge = [("en", "", 3 * 10**13), ("en", "a", 10**13), ("en", "b", 10**13 - 7), ("en", "a b", 10**13 - 9)]
    runs = spark.createDataFrame([(lang, p.split(), c) for lang, p, c in huge], "lang string, words array<string>, c long")
    monkeypatch.setattr(collocations, "frequent_runs", lambda *_: runs)
    (r,) = collocations.collocations(None).collect()
    assert r["score"] == 1000000 * (10**13 - 9) ** 2 // (10**13 * (10**13 - 7)) and r["n"] == 3 * 10**13


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, ROWS).limit(0)).collect() == []
    assert collocations.collocations(docs(spark, [(1, None, None, None)])).collect() == []


# --- URL filters

URLS = [
    "https://www.example.com/en/1", "https://example.com/en/1?x=/fr/", "http://a.b.EXAMPLE.com/en/", "http://notexample.com/en/", "http://example.com", "http://example.com?/en/", "http://example.com/e", "http://x.net/fr/1#top", "http://x.net/es",
    "http://net/es/", "http://x.net/de/1", "http://x.org/en/", "x.com/en/", None, "", "://", "http:///en/", "http://example.com:80/en/", "http://casino-win.example.org/en/1", "http://m.adult-x.example.net/de/2", "http://ththan.example.org/en/77",
    "http://museum.example.org/fr/3", "http://x.org/" + "long/" * 60_000, "http://É.org/ÀB/c", "http://x.org/a\nb?c",
]


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[0]), default=None)


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, *CLASH[:4]) for i, u in enumerate(URLS)] + [(0, URLS[0], *CLASH[:4]), (None, URLS[1], *CLASH[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, page string, host string, rule string, probability string")
    got = urlfilter.judge_urls(pages).select("page.*", F.col("host").alias("h"), F.col("path").alias("p"), F.col("rule").alias("r"), "verdict", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute_url(r["url"])
        assert (r["h"], r["p"], r["r"]) == (host, path, rule and rule[0]), r["url"][:80]
        assert r["verdict"] == (rule[1] if rule else ("block" if r["score"] >= 0.5 else "allow")) and 0 <= r["score"] <= 1
    said = {r["url"]: r["verdict"] for r in got}
    assert said["http://casino-win.example.org/en/1"] == said["http://m.adult-x.example.net/de/2"] == "block"
    assert said["http://ththan.example.org/en/77"] == said["http://museum.example.org/fr/3"] == said[None] == said[""] == "allow"
    assert urlfilter.judge_urls(pages.limit(0)).isEmpty()


def test_the_classifier_on_hosts_it_has_not_seen(spark):
    labelled = urlfilter.labelled_urls(spark)
    part = F.pmod(F.xxhash64(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]*)", 1)), F.lit(4))
    model = urlfilter.train(labelled.where(part != 0))
    host, path = urlfilter.host_and_path("url")
    held = labelled.where(part == 0).select("label", host.alias("host"), path.alias("path"))
    found = model.transform(urlfilter.with_features(held, "host", "path")).groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()
    n = {(r["label"], r["prediction"]): r["n"] for r in found}
    assert n[1.0, 1.0] >= 0.75 * (n[1.0, 1.0] + n.get((1.0, 0.0), 0)) and n[0.0, 0.0] >= 0.95 * (n[0.0, 0.0] + n.get((0.0, 1.0), 0))


def test_the_callers_own_labels_and_their_bound(spark):
    own = spark.createDataFrame([(f"http://{'qq' if i % 2 else 'zz'}{i}.org/", float(i % 2)) for i in range(60)] + [(None, 1.0), ("http://x.org", None)], "url string, label double")
    pages = spark.createDataFrame([(1, "http://qq99.org/"), (2, "http://zz99.org/")], "page_id long, url string")
    assert {r["page"]["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, own, rules=[]).collect()} == {1: "block", 2: "allow"}
    assert urlfilter.train(own, most=20).numFeatures == urlfilter.FEATURES


# --- filter audit


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails, parts = [], collections.defaultdict(list)
    for at, (i, text, _, source) in enumerate(rows):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bits = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and least[text] < i,
        }
        fails.append({f for f, b in bits.items() if b})
        parts[source or ""].append(at)
    out = {}
    for part, own in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order):
                gone = [x for x in left if f in fails[x]]
                left = [x for x in left if f not in fails[x]]
                shapley[f] += len(gone)
                out[part, order, step + 1] = [len(left), len(gone), sum(f in fails[x] for x in own) - len(gone), sum(fails[x] == {f} for x in own), sum(rows[x][0] in good for x in gone), sum(rows[x][0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(n):
    rng = np.random.default_rng(n)
    texts = ["Plain words " * 3, " ".join(f"w{i}" for i in range(210)), " ".join(f"w{i % 50}" for i in range(210)), "LOUD " + " ".join(f"L{i}" for i in range(300)), "x # y", None, "", "a b \x0b c\x0cd", "\U0001f600A" * 300]
    return [(int(i) if i >= 0 else None, texts[t] if t < len(texts) else f"text {t}", "en", [None, "", "s1", "s2"][s]) for i, t, s in zip(rng.integers(-2, 3 * n, n), rng.integers(0, 14, n), rng.integers(0, 4, n), strict=True)]


def test_audit_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(storage, "hot_limit", lambda total: 2)  # hot keys at this size
    rows = audited(300)
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 700, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (10_000, 1, 1)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in audit.filter_audit(docs(spark, rows).repartition(6), df).collect()}
    want = brute_audit(rows, labels)
    assert got == want and len(want) == 3 * 600
    empty = audit.filter_audit(docs(spark, rows).limit(0), df)
    assert empty.isEmpty() and empty.columns == ["part", "filter_order", "step", *audit.COUNTS]
    alone = audit.filter_audit(docs(spark, rows[:5]), df.limit(0))
    assert alone.where("good_lost + toxic_lost > 0").isEmpty() and alone.count() == 600 * len({r[3] or "" for r in rows[:5]})


def test_words_of_very_long_texts(monkeypatch):
    text = ("word \x0b" * 1000 + "Other ").encode()
    short = audit.text_fails(text)
    monkeypatch.setattr(audit, "LONG_TEXT", 10)
    assert audit.text_fails(text) == short == 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_are_those_of_the_operators(spark):
    d = "/root/testdata/sf0.001"
    q = queries.queries()
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in q["op11_collocations"](spark, d).collect()) == sorted(brute_collocations(rows))
    for r in q["op12_url_filter"](spark, d).collect():
        assert r["rule"] or r["verdict"] in ("allow", "block")
