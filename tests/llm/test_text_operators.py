"""Each text operator against brute force on a small fixture, with nulls, clashes, repeats and empty tables."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import decontam, graph, jaccard, langid, linededup, pii, sharding, simhash, storage, warc

SCHEMA = "lang string, doc_id long, text string, n_chars long, doc string, spans string, key string, _h string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, rows, parts=3):
    return spark.createDataFrame([("en", i, t, len(t) if t else 0, "clash", None, None, None) for i, t in rows], SCHEMA).repartition(parts)


def sentences(n, seed=0, size=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéi", k=rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choices(vocab, k=rng.randint(1, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    base = sentences(60)
    near = [b + " tail" for b in base[:10]] + [base[3]] * 12
    lines = [f"{b}\n  Shared LINE \t\n{c}" for b, c in zip(base[:11], base[11:22], strict=True)]
    texts = [*base, *near, *lines, None, "", "\n\n", "!!!", "one", "One", "a b c d", base[0] * 300]
    return [*enumerate(texts), (None, "null id text here"), (None, None), (5, base[5]), (5, base[6])]


# --- decontamination


def windows_of(items):
    out = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            out[tuple(w[s : s + 13])].add(i)
    return out


@pytest.mark.parametrize("slices", [10_000, 20])
def test_contamination(spark, corpus, slices):
    items = [(1, corpus[0][1]), (10, corpus[1][1][:40]), (2, corpus[2][1] + " " + corpus[3][1]), (3, None), (4, "..."), (7, "one"), (None, corpus[4][1])]
    bench = spark.createDataFrame([("x", i, t) for i, t in items], "text2 string, item_id long, text string")
    got = decontam.summary(decontam.contamination(table(spark, corpus), bench, max_windows=slices)).collect()
    win = windows_of(items)
    want = []
    for i, t in corpus:
        w, hit, found = words(t), set(), set()
        for k, ids in win.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= {x for x in ids if x is not None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = decontam.decontaminate(table(spark, corpus), bench)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and kept.count() == sum(not x[5] for x in want)
    assert decontam.contamination(table(spark, corpus).limit(0), bench).count() == 0
    assert decontam.summary(decontam.contamination(table(spark, corpus), bench.limit(0))).where("n_hit > 0").count() == 0


# --- line dedup


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


@pytest.mark.parametrize("resident", [1_000_000, 2])
def test_line_dedup(spark, corpus, resident):
    df = table(spark, corpus)
    counts = collections.Counter(k for _, t in corpus for k in {line_key(x) for x in (t or "").split("\n")} if k)
    common = {k for k, n in counts.items() if n >= 3}
    assert common
    out = linededup.drop_repeated_lines(df, min_docs=3, resident=resident, shard_keys=2)
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.summary(out).collect())
    want = collections.Counter()
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) not in common]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert got == want
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n, np.uint64))
        h = linededup.PerfectHash.build(keys)
        assert sorted(h.find(keys)) == list(range(len(keys)))


# --- SimHash


def test_edited_and_next(spark, corpus):
    got = simhash.edited_fingerprints(table(spark, corpus), per_task=300).collect()
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    texts = [t or "" for _, t in rows]
    want = collections.Counter()
    for n, (i, _) in enumerate(rows):
        t, x = texts[n], texts[(n + 1) % len(rows)]
        q = len(t) // 4
        fp, fe, fn = (int(simhash.fingerprints([s])[0]) for s in (t, t[: len(t) - q] + x[:q], x))
        same = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + x[:q]).encode()).hexdigest(), f"{fp:x}", same(fp, fe), same(fp, fn)] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], f"{r['fp'] & (2**64 - 1):x}", r["near_edited"], r["near_next"]) for r in got) == want
    assert simhash.edited_fingerprints(table(spark, corpus).limit(0)).count() == 0
    assert simhash.edited_fingerprints(table(spark, corpus[:1])).head()["near_next"] == 1.0


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 4), (3, 6), (6, 8)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 1))) for f in base for _ in range(4)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r["query_fp"], r["fp"]) for r in simhash.within_radius(df, df, radius, blocks).collect()}
    assert got == {(signed(a), signed(b)) for a in fps for b in fps if bin(a ^ b).count("1") <= radius}


# --- Jaccard join


def sets_of(rows):
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def test_similarity_join(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)  # so that groups span several tasks
    rows = [r for r in corpus if r[0] is not None][:-1]
    rng = random.Random(4)
    base = sentences(1, 9, 300)[0].split()
    rows += [(1000 + i, " ".join(w if rng.random() > 0.004 else "zz" for w in base)) for i in range(25)]
    got, want = joined_rows(spark, rows), brute_links(rows)
    assert got == want
    kept = {r["doc_id"] for r in jaccard.keep_one_of_each(table(spark, rows)).select("doc_id").collect()}
    assert kept == {class_id for _, _, class_id in want}
    assert jaccard.similarity_join(table(spark, rows).limit(0)).count() == 0


def joined_rows(spark, rows):
    return collections.Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.similarity_join(table(spark, rows)).collect())


def brute_links(rows):
    """(doc_id, n_links, class_id) of each row, every pair of rows compared."""
    s = sets_of(rows)
    links, root = [0] * len(s), list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for m, (_, a) in enumerate(s):
        for n in range(m + 1, len(s)):
            b = s[n][1]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[m] += 1
                links[n] += 1
                x, y = find(m), find(n)
                root[max(x, y)] = min(x, y)
    least = {}
    for m, (i, _) in enumerate(s):
        least[find(m)] = min(least.get(find(m), i), i)
    return collections.Counter((i, links[m], least[find(m)]) for m, (i, _) in enumerate(s))


def test_rows_of_one_id_with_different_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    rng = random.Random(9)
    near = lambda words, n: " ".join(w if x != n else "zz" for x, w in enumerate(words))
    rows = []
    for i in range(1, 41):  # two texts of each id and a near copy of each
        for h in range(2):
            words = [f"w{rng.randrange(400)}" for _ in range(80)]
            rows += [(i, " ".join(words)), (100 + 2 * i + h, near(words, 79))]
    one = [f"v{x}" for x in range(63)]  # near copies of one id, copies of a row among them
    rows += [(900, near(one, rng.choice([0, 1, 61, 62])) + f" t{n}") for n in range(150)] + [(900, " ".join(one))] * 30
    assert joined_rows(spark, rows) == brute_links(rows)
    kept = collections.Counter(r["doc_id"] for r in jaccard.keep_one_of_each(table(spark, rows)).collect())
    assert kept == collections.Counter([i for i in range(1, 41) for _ in range(2)] + [900])


def test_ten_thousand_rows_of_one_id(spark):
    words = [f"w{x}" for x in range(200)]
    rows = [(1, " ".join(words[: 200 - n % 3])) for n in range(10_000)]
    got = jaccard.similarity_join(table(spark, rows)).groupBy("class_id", "n_links", "copy_id").count().collect()
    assert [tuple(r) for r in got] == [(1, 9_999, 1, 10_000)]
    assert jaccard.keep_one_of_each(table(spark, rows)).count() == 1


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * jaccard.PERMS
    rng = np.random.default_rng(1)
    for s, want in ((0.85, 400), (0.3, 0)):
        a = rng.integers(0, 256, (400, jaccard.PERMS), np.uint8)
        b = np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape, np.uint8))
        sig = np.concatenate([a, b])
        assert len(jaccard.surviving_pairs(sig, np.arange(400), np.arange(400, 800))) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(41), 200]) and got[102] == 100 and len(got) == 45


def test_join_hot_is_a_left_join(spark):
    big = spark.createDataFrame([("h",)] * 300 + [("c",)] * 3 + [(None,)] + [("x",)], "k string")
    small = spark.createDataFrame([("h", 300, 1), ("c", 3, 2)], "k string, n int, v int")
    small = small.withColumnRenamed("k", "key")
    out = storage.join_hot(big.withColumnRenamed("k", "key"), small, "key", "n", 305, ["v"])
    assert collections.Counter(tuple(r) for r in out.collect()) == {("h", 1): 300, ("c", 2): 3, (None, None): 1, ("x", None): 1}


# --- language ID


def test_forward_sums_all_segmentations():
    model = {"pieces": ["▁", "▁a", "a", "ab", "b"], "langs": ["x"], "prob": np.array([[0.1], [0.2], [0.3], [0.15], [0.2], [0.0], [0.01]]), "prior": np.zeros(1)}
    logs, n = langid.Scorer(model).log_probs(["ab", "aab", "1 !", None])
    p = dict(zip(model["pieces"], model["prob"][:, 0], strict=False))

    def total(word):
        return 1.0 if not word else sum(p.get(word[:k], 0) * total(word[k:]) for k in range(1, len(word) + 1))

    assert logs[:2, 0] == pytest.approx([np.log(total("▁ab")), np.log(total("▁aab"))], rel=1e-5) and list(n) == [1, 1, 0, 0]


def test_language_id(spark):
    rng = random.Random(1)
    speech = {"aa": ["ba", "be", "bu"], "cc": ["ka", "ke", "ku"]}
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(speech))
        rows.append((lang, i, " ".join("".join(rng.choices(speech[lang], k=3)) for _ in range(6)), "clash"))
    rows += [("aa", 500, None, "x"), ("aa", 501, "12 !?", "x"), (None, 502, "baba bebu", "x"), (None, None, "kaka", "x"), ("cc", 503, "k" * 5000, "x"), ("aa", 504, "", None)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string, lang_pred string")
    got = langid.identify(df).selectExpr("doc.doc_id", "doc.lang", "lang_pred", "score", "held_out").collect()
    by = {r["doc_id"]: r for r in got}
    import zlib

    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 500:
            assert r["lang_pred"] == r["lang"]
    assert [by[i]["lang_pred"] for i in (500, 501, 502, None, 503, 504)] == ["und", "und", "aa", "cc", "cc", "und"]
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


# --- PII


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_base_spans_are_the_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    only = lambda s: re.sub(r"[^0-9]", "", s)
    rng = random.Random(7)
    bits = ["1", "2", "4111111111111111", "9", ".", " ", "-", "+", "(", ")", "@", "a", "é", ".com", "255", "x", "1.2", "%", "_", "٣"]
    for _ in range(5000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 24)))
        want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(only(m[0])) <= 15]
        assert pii.base_spans(t) == want, t


def test_added_spans_and_context():
    assert [x[0] for x in pii.spans_of("pay to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert not pii.spans_of("pay to GB82 WEST 1234 5698 7654 33 now")
    assert pii.spans_of("my card 378282246310005")[0][0] == "card_short" and not pii.spans_of("code 378282246310005")
    assert pii.spans_of('token = "9b0b3c6a43eb78aa99cbd7049c572391"')[0][0] == "secret"
    assert pii.spans_of("card 4111111111111111")[0][3] > pii.spans_of("word 4111111111111111")[0][3]


def test_pii_table(spark):
    rows = [(1, "é a.b@c.de"), (2, None), (None, "1.2.3.4"), (3, ""), (3, ""), (4, "9" * 200_000)]
    got = {(r["doc_id"], r["spans"]) for r in pii.summary(pii.find_pii(table(spark, rows))).collect()}
    assert got == {(1, "email:2:10"), (2, ""), (None, "ip:0:7"), (3, ""), (4, "")}
    assert pii.find_pii(table(spark, rows).limit(0)).count() == 0


# --- WARC


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", broadcast)
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * 50) for i in range(40)] + [(50, None, None), (51, "u\nv", ""), (None, "u", "<p>3</p>" * 50), (60, "a", "only"), (60, "b", "only"), (60, "b", "only"), (60, "b", "other"), (61, "é", "日本" * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string").repartition(4)
    manifest = warc.write_warc(df, storage.shared_folder(spark, "w"), roll_bytes=3000, per_task=4000)
    assert manifest.agg({"n_records": "sum"}).head()[0] == len(rows) and manifest.count() > 4
    raw = {r["file"]: warc.read_file(r["file"]) for r in manifest.collect()}
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(manifest).collect())
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h in rows:
        b, r = (h or "").encode(), last.get(h or "")
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want[i, len(b), digest, "response" if r in (i, None) else "revisit", None if r in (i, None) else r] += 1
    assert got == want
    again = warc.write_warc(df.repartition(2), storage.shared_folder(spark, "w"), roll_bytes=3000, per_task=4000)
    assert sorted(warc.read_file(r["file"]) for r in again.collect()) == sorted(raw.values())  # same rows, same bytes
    records = [h for data in raw.values() for h, _ in warc.parse_warc(data)]
    ids = {h["WARC-Record-ID"]: h for h in records}
    assert len(ids) == len(records)
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    for h in revisits:  # another reader finds the response by the format's own headers
        to = ids[h["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] and to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and to["X-Page-Id"] == h["X-Refers-To-Page-Id"]
    assert len(revisits) > 30 and {h["WARC-Target-URI"] for h in records if h.get("X-Page-Id") == "51"} == {"uv"}
    assert warc.archive(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_the_querys_own_files_roll(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    files = warc.write_warc(pages, storage.shared_folder(spark, "w")).orderBy("file").collect()
    assert max(f["number"] for f in files) > 0 and all(f["n_bytes"] > warc.ROLL_BYTES for f in files[:-1])


# --- sharding


def test_sharding(spark, corpus):
    rows = corpus + [(77, "same id " * n) for n in range(1, 40)] + [(78, "z" * 5000)]
    got = sharding.shard_documents(table(spark, rows), limit=900).collect()
    assert len(got) == len(rows)
    total, n = collections.Counter(), collections.Counter()
    for r in got:
        total[r["shard"]] += r["doc_bytes"]
        n[r["shard"]] += 1
    for r in got:
        assert r["shard_bytes"] == total[r["shard"]] and (total[r["shard"]] <= 900 or n[r["shard"]] == 1)
        if "." not in r["shard"]:
            i = r["doc"]["doc_id"]
            h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
            assert f"{h:060b}".startswith(r["shard"]) and len(r["shard"]) == r["depth"]
    plain = {s for s in total if "." not in s}
    for s in plain - {""}:  # no shorter prefix would fit
        h = lambda i: f"{int(hashlib.md5(('' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}"
        assert sum(len((t or "").encode()) for i, t in rows if h(i).startswith(s[:-1])) > 900
    assert sharding.shard_documents(table(spark, rows).limit(0)).count() == 0


def test_directory_without_a_broadcast_is_the_same(spark, monkeypatch):
    """Also where too many cells are over the limit to be broadcast; half of all rows have one id."""
    docs = spark.createDataFrame([(i if i % 2 else 0, "x" * (10 + i % 7)) for i in range(600)], "doc_id long, text string")
    rows = lambda: {(r["doc"]["doc_id"], r["doc"]["text"], r["shard"], r["shard_bytes"]): r["n"] for r in sharding.shard_documents(docs, 200).groupBy("doc", "shard", "shard_bytes").agg(F.count("*").alias("n")).collect()}
    want = rows()
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 0)
    got = rows()
    assert {k[2] for k in got} == {k[2] for k in want} and sum(got.values()) == sum(want.values()) == 600 and len({k[2] for k in got}) > 10
    assert {k for k in got if k[0]} == {k for k in want if k[0]}
