"""Similarity join on word shingles: Jaccard >= threshold, candidates pruned by their posterior probability.

1. Each text becomes its set of ``SHINGLE``-word shingles with a MinHash signature;
   texts of equal sets are one class from here on.
2. Bands of the signature propose candidates: classes that agree on a whole band
   share a bucket. Buckets with the same members are looked at once; a large one is
   cut into chunks and every pair of chunks is a task of its own.
3. A task compares signatures in steps of ``STEP`` values and drops a pair when the
   posterior probability that its similarity reaches the threshold falls below
   ``TOLERANCE``. What stays is linked to components; no list of pairs is made.
4. Each component's texts meet in tasks of bounded size (pairs of chunks again),
   where all similarities are computed exactly from the shingle sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.graph import components
from roadtrace.llm.kernels import Words, chunks, doc_shingles, iter_groups, mix
from roadtrace.llm.storage import join_hot, materialize, partitions_for, small_batches

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: 32 bands of 4 values: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS, STEP = 32, 4, 16
PERMS = BANDS * ROWS
#: Classes and shingles of a chunk.
CHUNK, CHUNK_SHINGLES = 512, 1_000_000


@functools.lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240517)
    return rng.integers(0, 2**63, PERMS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PERMS, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """PERMS 32-bit minima of a non-empty set of shingle hashes."""
    a, b = _family()
    out = np.full(PERMS, 2**32 - 1, np.uint64)
    for s in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[s : s + 4096, None] * a + b) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart, whatever their order."""
    return mix(shingles, 11).sum(dtype=np.uint64).tobytes() + mix(shingles, 13).sum(dtype=np.uint64).tobytes()


def shingle_sets(texts: list, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (a text of fewer words, but not none, is one shingle)."""
    words = Words(texts)
    every, bounds = doc_shingles(words, k)
    return [np.unique(every[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, key (null: no words), n (distinct shingles), bands (hashes), sig (low bytes of the minima)."""
    small_batches(docs.sparkSession)

    def run(batches):
        band_salt = mix(np.arange(BANDS, dtype=np.uint64), 21)
        for batch in batches:
            keys, ns, bands, sigs = [], [], [], []
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                for s in shingle_sets(texts[a:b], k):
                    ns.append(len(s))
                    if not len(s):
                        keys.append(None), bands.append(None), sigs.append(None)
                        continue
                    m = minhash(s)
                    h = band_salt
                    for column in m.reshape(BANDS, ROWS).T:
                        h = mix(h ^ column.astype(np.uint64), 1)
                    keys.append(set_key(s)), bands.append(h.view(np.int64)), sigs.append((m & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "key", "n", "bands", "sig"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, text_hash long, key binary, n long, bands array<long>, sig binary")


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """After each step of the comparison, the fewest equal values with which a pair stays.

    The prior of the similarity is uniform; low bytes are also equal by chance (1 in 256).
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for r in range(STEP, PERMS + 1, STEP):
        m = np.arange(r + 1)[:, None]
        log = m * np.log(p) + (r - m) * np.log1p(-p)
        w = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = w[:, s >= threshold].sum(axis=1) / w.sum(axis=1)
        out.append(int(np.argmax(posterior >= tolerance)))
    return np.array(out)


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) of signature rows stay after all steps."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for step, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(step * STEP, (step + 1) * STEP)
        matches[alive] += (sig[left[alive], part] == sig[right[alive], part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each member's connected set."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(side: np.ndarray, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within one chunk, or between the two chunks of a task."""
    if not crossing:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _chunk_tasks(rows: DataFrame, group: str, k: str) -> DataFrame:
    """Rows (with ``group``, number of chunks ``k`` and key) to tasks of chunk pairs: task, crossing, side."""
    own = rows.withColumn("_c", F.expr(f"cast(pmod(xxhash64(key), {k}) as int)"))
    own = own.withColumn("_o", F.explode(F.expr(f"sequence(0, {k} - 1)")))
    task = F.sha2(F.concat_ws(":", F.hex(group), F.least("_c", "_o"), F.greatest("_c", "_o")), 224)
    return own.select("*", task.alias("task"), (F.col("_c") != F.col("_o")).alias("crossing"), (F.col("_c") > F.col("_o")).cast("int").alias("side")).drop("_c", "_o")


def candidate_components(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, root): components of the pairs of classes (key, bands, sig) that survive the pruning."""
    spark = classes.sparkSession
    bands = classes.select("key", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("who")).where("n > 1")
    buckets = materialize(buckets.groupBy("n", "who").agg(F.min("band").alias("band")).select("band", "n"), "buckets")
    members = join_hot(bands, buckets, "band", "n", buckets.agg(F.sum("n")).head()[0] or 0, ["n"]).where("n is not null")
    members = members.join(classes.select("key", "sig"), "key").withColumn("k", F.expr(f"cast(ceil(n / {CHUNK}) as int)"))
    tasks = _chunk_tasks(members.select("key", "sig", "band", "k"), "band", "k").select("task", "crossing", "side", "key", "sig")
    count = buckets.agg(F.sum(F.expr(f"n * ceil(n / {CHUNK})"))).head()[0] or 0
    tasks = tasks.repartition(partitions_for(spark, int(count) * 200, 8 << 20), "task").sortWithinPartitions("task")

    def prune(batches):
        for frame in iter_groups((b.to_pandas() for b in batches), "task"):
            left, right = [], []
            sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(-1, PERMS)
            side, crossing = frame["side"].to_numpy(), frame["crossing"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], frame["task"].to_numpy()[1:] != frame["task"].to_numpy()[:-1], [True]]))
            small = np.diff(cuts) == 2
            firsts = cuts[:-1][small]
            keep = surviving_pairs(sig, firsts, firsts + 1, threshold, tolerance)
            left.append(firsts[keep])
            right.append(firsts[keep] + 1)
            for a, b in zip(cuts[:-1][~small], cuts[1:][~small], strict=True):
                i, j = _pairs(side[a:b], bool(crossing[a]))
                keep = surviving_pairs(sig[a:b], i, j, threshold, tolerance)
                root = _roots(b - a, i[keep], j[keep])
                moved = np.flatnonzero(root != np.arange(b - a))
                left.append(a + moved)
                right.append(a + root[moved])
            key = frame["key"].to_numpy()
            yield pa.RecordBatch.from_pydict({"a": pa.array(key[np.concatenate(left)], pa.binary()), "b": pa.array(key[np.concatenate(right)], pa.binary())})

    return components(tasks.mapInArrow(prune, "a binary, b binary"))


def exact_links(sets: list[np.ndarray], side: np.ndarray, crossing: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose Jaccard similarity is at least the threshold, from exact intersections."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[ids] > 1  # shingles of one set alone are in no intersection
    number = np.cumsum(n > 1) - 1
    owner, ids = owner[shared], number[ids[shared]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (4 << 20) // len(sets))
    for first in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        a, b = np.searchsorted(ids, [first, first + width])
        x = np.zeros((len(sets), min(width, int(ids[b - 1]) - first + 1)), np.float32)
        x[owner[a:b], ids[a:b] - first] = 1
        both += x @ x.T
    i, j = _pairs(side, crossing)
    inter = both[i, j].astype(np.int64)
    ok = inter >= threshold * (sizes[i] + sizes[j] - inter) - 1e-9
    return i[ok], j[ok]


def _text_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """_z (no id), _i, _t: which text of the table a row holds, ids in order and none last."""
    return [doc_id.isNull().alias("_z"), F.coalesce(doc_id, F.lit(0)).alias("_i"), text_hash.alias("_t")]


def verified_links(docs: DataFrame, classes: DataFrame, comps: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """key, root, links: for each class in a component and each of its tasks the rows of linked classes and the least linked class there."""
    spark = docs.sparkSession
    nodes = comps.join(classes.select("key", "first", "size", "n"), F.col("node") == F.col("key")).select("key", "root", "first", "size", "n")
    nodes = materialize(nodes, "nodes")
    volume = nodes.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    volume = materialize(volume.withColumn("k", F.expr(f"cast(greatest(ceil(m / {CHUNK}), ceil(w / {CHUNK_SHINGLES}), 1) as int)")), "volume")
    count, total = volume.agg(F.sum("m"), F.sum(F.expr("w * k"))).head()
    sized = join_hot(nodes, volume, "root", "m", count or 0, ["k"])
    # one text of each id and hash, however often its row repeats; the join takes the grouping's partitions
    texts = docs.select(*_text_key(F.col("doc_id").cast("long"), F.xxhash64("text")), "text").groupBy("_z", "_i", "_t").agg(F.first("text").alias("text"))
    rows = texts.join(sized.select("key", "root", "size", "k", "first.*"), ["_z", "_i", "_t"]).select("key", "root", "size", "k", "text")
    tasks = _chunk_tasks(rows, "root", "k").select("task", "crossing", "side", "key", "size", "text")
    tasks = tasks.repartition(partitions_for(spark, int(total or 0) * 6, 8 << 20), "task").sortWithinPartitions("task")

    def verify(batches):
        for frame in iter_groups((b.to_pandas() for b in batches), "task"):
            for _, own in frame.groupby("task", sort=False):
                texts = own["text"].tolist()
                sets = [s for a, b in chunks(texts) for s in shingle_sets(texts[a:b], k)]
                keys = own["key"].tolist()
                ok = np.array([len(s) > 0 and set_key(s) == bytes(key) for s, key in zip(sets, keys, strict=True)], bool)
                if ok.sum() < 2:
                    continue
                at = np.flatnonzero(ok)
                side, size = own["side"].to_numpy()[at], own["size"].to_numpy()[at]
                i, j = exact_links([sets[x] for x in at], side, bool(own["crossing"].iloc[0]), threshold)
                links = np.bincount(i, size[j], len(at)) + np.bincount(j, size[i], len(at))
                root = _roots(len(at), i, j)
                some = np.flatnonzero(links > 0)
                key = own["key"].to_numpy()[at]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[some], pa.binary()), "root": pa.array(key[root[some]], pa.binary()), "links": pa.array(links[some].astype(np.int64))})

    return tasks.mapInArrow(verify, "key binary, root binary, links long")


def similarity_join(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of all rows linked to it directly or through others), n_links, copy_id (least doc_id of rows with the same shingles).

    ``n_links`` counts all other rows of similarity >= ``threshold``, copies included. A
    null or wordless text is linked to nothing: its class and copy are its own
    doc_id. Repeated rows are copies of each other, and rows of one id with different
    texts are rows of their own. A null doc_id counts as a row but names no class. An
    empty table gives no rows.
    """
    return _joined(docs, k, threshold, tolerance).drop("text_hash", "class_hash")


def _joined(docs: DataFrame, k: int, threshold: float, tolerance: float) -> DataFrame:
    sigs = materialize(signatures(docs, k), "signatures")
    grouped = sigs.where("key is not null").groupBy("key").agg(F.min(F.struct(*_text_key(F.col("doc_id"), F.col("text_hash")))).alias("first"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(grouped, "classes")
    comps = candidate_components(classes, threshold, tolerance)
    links = materialize(verified_links(docs, classes, comps, k, threshold), "links")
    groups = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    per_class = links.groupBy("key").agg(F.sum("links").alias("links"))
    rep = F.when(~F.col("first._z"), F.struct(F.col("first._i").alias("id"), F.col("first._t").alias("hash")))
    named = classes.select("key", rep.alias("rep"), "size").join(groups.select(F.col("node").alias("key"), "root"), "key", "left").join(per_class, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key")).where("links is not null or size > 1")
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("class"), F.count("*").alias("m"))
    least = materialize(least, "least")
    info = join_hot(named, least, "root", "m", named.count(), ["class"])
    info = materialize(info.select("key", F.col("class.id").alias("class_id"), F.col("class.hash").alias("class_hash"), F.col("rep.id").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "size"), "info")
    out = join_hot(sigs.select("doc_id", "text_hash", "key"), info, "key", "size", sigs.count(), ["class_id", "class_hash", "copy_id", "n_links"])
    return out.select("doc_id", "text_hash", "class_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row of each class of ``similarity_join``: that of the least doc_id (of its texts in the class, the one of the least hash).

    Rows that repeat both doc_id and text are one; rows of a null id all stay.
    """
    joined = materialize(_joined(docs, SHINGLE, THRESHOLD, TOLERANCE).select("doc_id", "text_hash", "class_id", "class_hash"), "joined")
    own = [F.col("doc_id").cast("long") == F.col("_d"), F.xxhash64("text") == F.col("_t")]
    named = lambda df: df.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    kept = docs.join(named(joined.where("class_id <> doc_id or class_hash <> text_hash")), own, "left_anti")
    twice = materialize(joined.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(named(twice), own, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(named(twice), own, "left_anti").unionByName(once)
