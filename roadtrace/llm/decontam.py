"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``window`` consecutive words of an item (all its words where it has
fewer). Exact containment needs every word run of a window, so the rarest of its
``shingle``-word runs, by their counts over all documents, is a sufficient
prefix: a document is looked at only where such a run occurs. The run's place in
the window gives the only possible start (positional bound), which must leave
room for the window inside the document (length bound); then all words are compared.

The index of windows is shared with the tasks in slices of at most
``MAX_WINDOWS`` windows, so that what is broadcast has a fixed bound; a larger
benchmark takes one pass over the documents for each slice. It holds words and
window numbers only: which items a window belongs to (one prompt header may stand
in all of them) is joined to the windows found by a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.kernels import Words, chunks, ragged, shingle_hashes
from roadtrace.llm.storage import BATCH_ROWS, join_hot, materialize, small_batches

WINDOW, SHINGLE = 13, 4
MAX_WINDOWS = 500_000
#: Sets or items of a window that meet in one part of the join.
PAIR_ROWS = 4096
_BLOOM = 1 << 22


def window_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window, words): the windows of each item, once each, with the md5 of their words joined by blanks; an item of no words has none."""

    def cut(batches):
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = Words([t])
                own = [w.data[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                runs = {b" ".join(own[s : s + window]) for s in range(max(1, len(own) - window + 1))} if own else ()
                names = [hashlib.md5(x).digest() for x in runs]
                for a in range(0, len(names), BATCH_ROWS):
                    n = len(names[a : a + BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(names[a : a + n], pa.binary()), pa.array([x.decode("utf-8", "surrogatepass") for x in list(runs)[a : a + n]], pa.string())], names=["item_id", "window", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    return items.mapInArrow(cut, "item_id long, window binary, words string")


class _Index:
    """Windows of one slice: words, their hashes, md5, and the runs among which the rarest is chosen; some 300 bytes a window."""

    def __init__(self, table: pa.Table, shingle: int):
        w = Words(table.column("words").to_pylist())
        self.n = np.diff(w.bounds)
        self.first, self.hashes, self.data, self.starts, self.ends = w.bounds[:-1], w.hashes, w.data, w.starts.astype(np.uint32), w.ends.astype(np.uint32)
        self.names = np.array(table.column("window").to_pylist(), "V16")
        self.run = np.minimum(self.n, shingle)
        self.every = {int(k): shingle_hashes(w.hashes, int(k)) for k in np.unique(self.run)}

    def text(self, i: int) -> bytes:
        return self.data[self.starts[self.first[i]] : self.ends[self.first[i] + self.n[i] - 1]]

    def runs(self) -> dict[int, np.ndarray]:
        """Run length: sorted distinct hashes of all runs of that length."""
        return {k: np.unique(h[self._places(k)[0]]) for k, h in self.every.items()}

    def _places(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the runs of the windows with runs of ``k`` words, those windows, and how many runs each has."""
        own = np.flatnonzero(self.run == k)
        n = self.n[own] - k + 1
        return ragged(self.first[own], n), own, n

    def choose(self, runs: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> None:
        """Take the rarest run of each window (ties: the first) as its prefix."""
        self.offset, chosen = np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.uint64)
        self.lookup = {}
        for k, h in self.every.items():
            at, own, n = self._places(k)
            often = counts[k][np.searchsorted(runs[k], h[at])]
            window = np.repeat(np.arange(len(own)), n)
            place = at - np.repeat(self.first[own], n)
            best = np.lexsort((place, often, window))[np.cumsum(n) - n]
            self.offset[own], chosen[own] = place[best], h[at[best]]
            own = own[np.argsort(chosen[own], kind="stable")]
            keys, first, n = np.unique(chosen[own], return_index=True, return_counts=True)
            self.lookup[k] = (_bloom(keys), keys, own, first, n)
        del self.every


def _bloom(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(_BLOOM, bool)
    table[(keys % np.uint64(_BLOOM)).astype(np.int64)] = True
    return table


def _find(hashes: np.ndarray, bloom: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is one of ``keys``, and which."""
    maybe = np.flatnonzero(bloom[(hashes % np.uint64(_BLOOM)).astype(np.int64)])
    spot = np.searchsorted(keys, hashes[maybe])
    spot[spot == len(keys)] = 0
    same = keys[spot] == hashes[maybe] if len(keys) else np.zeros(0, bool)
    return maybe[same], spot[same]


def _run_counts(docs: DataFrame, runs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each run occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def count(batches):
        runs, blooms = shared.value, {k: _bloom(h) for k, h in shared.value.items()}
        sums = {k: np.zeros(len(h), np.int64) for k, h in runs.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                for k, keys in runs.items():
                    _, which = _find(shingle_hashes(w.hashes, k), blooms[k], keys)
                    sums[k] += np.bincount(which, minlength=len(keys))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int32()), "run": pa.array(at, pa.int64()), "n": pa.array(s[at], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "k int, run long, n long").groupBy("k", "run").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(h), np.int64) for k, h in runs.items()}
    found = rows.toArrow()  # at most the runs of one slice, as arrays
    k, run, n = (found.column(c).to_numpy() for c in ("k", "run", "n"))
    for size, counts in out.items():
        own = k == size
        counts[run[own]] = n[own]
    return out


def _hits(words: Words, index: _Index) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: first word (position in ``words``) and window."""
    firsts, which = [], []
    doc_end = words.bounds[1:]
    for k, (bloom, keys, own, first, n) in index.lookup.items():
        at, key = _find(shingle_hashes(words.hashes, k), bloom, keys)
        window = own[ragged(first[key], n[key])]
        start = np.repeat(at, n[key]) - index.offset[window]
        doc = np.searchsorted(doc_end, np.repeat(at, n[key]), side="right")
        ok = (start >= words.bounds[doc]) & (start + index.n[window] <= doc_end[doc])
        start, window = start[ok], window[ok]
        sizes = index.n[window]
        same = words.hashes[ragged(start, sizes)] == index.hashes[ragged(index.first[window], sizes)]
        group = np.repeat(np.arange(len(sizes)), sizes)
        ok = np.bincount(group[same], minlength=len(sizes)) == sizes
        start, window = start[ok], window[ok]
        exact = [
            b" ".join(words.data[a:b] for a, b in zip(words.starts[s : s + m], words.ends[s : s + m], strict=True)) == index.text(w)
            for s, w, m in zip(start.tolist(), window.tolist(), index.n[window].tolist(), strict=True)
        ]
        exact = np.array(exact, bool)
        firsts.append(start[exact])
        which.append(window[exact])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(which)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) in ``doc`` (struct), and n_words, hits (array of [first word, end word)), windows (md5 of those found).

    A null or wordless text has no words and no hits. Repeated rows each get their
    result; an empty benchmark gives no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = materialize(window_items(benchmark, window).select("window", "words").distinct(), "windows")
    slices = max(1, -(-windows.count() // max_windows))
    out = docs.select(F.col("text"), F.struct(*(keep or ["*"])).alias("doc"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hits"), F.array().cast("array<binary>").alias("windows"))
    schema = out.schema
    for part in range(slices):
        own = windows if slices == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == part)
        index = _Index(own.orderBy("words").toArrow(), shingle)  # at most about max_windows rows
        index.lookup = {}
        if len(index.n):
            runs = index.runs()
            index.choose(runs, _run_counts(docs, runs))
        shared = spark.sparkContext.broadcast(index)

        def look(batches, shared=shared):
            index = shared.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                n_words, ranges, found = [], batch.column("hits").to_pylist(), batch.column("windows").to_pylist()
                for a, b in chunks(texts):
                    w = Words(texts[a:b])
                    n_words += np.diff(w.bounds).tolist()
                    start, which = _hits(w, index)
                    doc = np.searchsorted(w.bounds[1:], start, side="right")
                    first = start - w.bounds[doc]
                    for d in np.unique(doc).tolist():
                        at = np.flatnonzero(doc == d)
                        ranges[a + d] += np.stack([first[at], first[at] + index.n[which[at]]], axis=1).reshape(-1).tolist()
                        found[a + d] = sorted({*found[a + d], *(index.names[i].tobytes() for i in np.unique(which[at]))})
                columns = [batch.column("text"), batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["text", "doc", "n_words", "hits", "windows"])

        out = out.mapInArrow(look, schema)
        if part < slices - 1:
            out = materialize(out, "contamination")
    return out.drop("text")


def _set_items(sets: DataFrame, members: DataFrame) -> DataFrame:
    """_set and items (sorted ids) of the sets of windows (_set, windows): windows meet their items by a shuffle, in parts where one is in very many sets or items."""
    links = sets.select("_set", F.explode("windows").alias("window"))
    pairs = links.groupBy("window").agg(F.count("*").alias("n_sets")).join(members.groupBy("window").agg(F.count("*").alias("n_items")), "window")
    sizes = materialize(pairs.withColumns({"sk": F.ceil(F.col("n_sets") / PAIR_ROWS).cast("int"), "ik": F.ceil(F.col("n_items") / PAIR_ROWS).cast("int")}), "window-sizes")
    n_sets, n_items, parts = sizes.agg(F.sum("n_sets"), F.sum("n_items"), F.max(F.greatest("sk", "ik"))).head()
    if (parts or 1) == 1:
        met = links.join(members, "window")
    else:
        left = join_hot(links, sizes, "window", "n_sets", n_sets, ["sk", "ik"]).where("sk is not null")
        left = left.select("_set", "window", F.expr("pmod(xxhash64(_set), sk)").alias("s"), F.explode(F.expr("sequence(0, ik - 1)")).alias("i"))
        right = join_hot(members, sizes, "window", "n_items", n_items, ["sk", "ik"]).where("sk is not null")
        right = right.select("item_id", "window", F.explode(F.expr("sequence(0, sk - 1)")).alias("s"), F.expr("pmod(xxhash64(item_id), ik)").alias("i"))
        met = left.join(right, ["window", "s", "i"])
    return met.select("_set", "item_id").distinct().groupBy("_set").agg(F.sort_array(F.collect_list("item_id")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """``mark``'s columns, and items (sorted ids of the items of the windows found), n_items and items_sha256 (of the ids as sorted strings).

    Items of a null id mark words but give no id. The ids are put together once for
    each different set of windows; such a list is as long as the benchmark at most.
    """
    marked = mark(docs, benchmark, window, shingle, max_windows, keep).withColumn("_set", F.when(F.size("windows") > 0, F.sha2(F.array_join(F.transform("windows", lambda x: F.hex(x)), ","), 256)))
    marked = materialize(marked, "marked")
    sets = materialize(marked.where("_set is not null").groupBy("_set").agg(F.first("windows").alias("windows"), F.count("*").alias("n")), "window-sets")
    members = window_items(benchmark, window).where("item_id is not null").select("window", "item_id").distinct()
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256)
    items = materialize(sets.drop("windows").join(_set_items(sets, members), "_set").withColumns({"n_items": F.size("items").cast("long"), "items_sha256": digest}), "window-set-items")
    out = join_hot(marked, items, "_set", "n", sets.agg(F.sum("n")).head()[0] or 0, ["items", "n_items", "items_sha256"]).drop("_set")
    none = {"items": F.array().cast("array<long>"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    return out.withColumns({c: F.coalesce(c, x) for c, x in none.items()})


def summary(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of ``contamination``'s rows."""
    rows = marked.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "n_words", F.expr(covered()).alias("n_hit"), "n_items", "items_sha256")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def covered(hits: str = "hits") -> str:
    """SQL for the number of words under the ranges of a row."""
    pairs = f"array_sort(transform(sequence(1, size({hits}) div 2), i -> struct({hits}[2 * i - 2] as a, {hits}[2 * i - 1] as b)))"
    step = "(s, r) -> struct(s.n + greatest(0L, r.b - greatest(r.a, s.e)) as n, greatest(s.e, r.b) as e)"
    return f"if(size({hits}) = 0, 0L, aggregate({pairs}, struct(0L as n, 0L as e), {step}).n)"


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, of which less than one word in twenty lies in a benchmark window."""
    marked = mark(docs, benchmark)
    hit = F.expr(covered())
    return marked.where((hit == 0) | (20 * hit < F.col("n_words"))).select("doc.*")
