"""Best-fit packing of token sequences with large-item matching, planned on the histogram of lengths.

Pieces of one length are interchangeable, so the plan needs only how many pieces
each length has (at most ``capacity`` numbers, whatever the corpus). Pieces of
more than a third of the capacity fit at most twice in a sequence: they are
matched greedily, the longest with the longest that still fits. The smaller ones
then go, longest first, to the sequence with the least sufficient gap. Spark
ranks the pieces within each length and looks their places up in the plan.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.llm.kernels import chunks
from roadtrace.llm.storage import materialize, small_batches
from roadtrace.llm.tokens import END_ID, digest, tokenizer_path, worker_tokenizer

CAPACITY = 4096
#: Pieces of one length that are ranked together: a length of more is ranked in parts.
RANKED = 1000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, offset): piece of rank r lies in sequence first + r - first rank."""
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, how many), all alike
    order: list[int] = []  # gaps in use, ascending
    free = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if not gap or not n:
            return
        if not gaps[gap]:
            bisect.insort(order, gap)
        gaps[gap].append((first, n))

    def take(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, first, offset))
        used[length] += n

    left = {k: c for k, c in counts.items() if c}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:  # longest first, with the longest partner that fits
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:
            take(a, left[a], free, 0)
            open_gap(capacity - a, free, left[a])
            free += left[a]
            large.pop()
            continue
        b = large[i]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n == 0:  # a single piece left of its own best partner
            if i > 0:
                b, n = large[i - 1], 1
            else:
                take(a, 1, free, 0)
                open_gap(capacity - a, free, 1)
                free += 1
                large.pop()
                continue
        take(a, n, free, 0)
        take(b, n, free, a)
        open_gap(capacity - a - b, free, n)
        free += n
        for k in (a, b):
            left[k] -= n
        large = [k for k in large if left[k]]
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[k]
        while n:
            i = bisect.bisect_left(order, k)
            if i == len(order):
                each = capacity // k
                whole = n // each
                if whole:
                    for j in range(each):
                        take(k, whole, free, j * k)
                    open_gap(capacity - each * k, free, whole)
                    free += whole
                    n -= whole * each
                if n:
                    for j in range(n):
                        take(k, 1, free, j * k)
                    open_gap(capacity - n * k, free, 1)
                    free += 1
                break
            gap = order[i]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(i)
            m = min(n, many)
            take(k, m, first, capacity - gap)
            open_gap(gap - k, first, m)
            open_gap(gap, first + m, many - m)
            n -= m
    return rows


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A null text is empty (one piece, the end id); repeated rows each count."""
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)

    def cut(batches):
        tokenizer, end = worker_tokenizer(path), np.array([END_ID], np.int32)
        for frame in batches:
            texts = [t if isinstance(t, str) else None for t in frame["_text"]]
            rows = []
            for a, b in chunks(texts):
                for d, ids in zip(frame["_id"].iloc[a:b], tokenizer.encode(texts[a:b]), strict=True):
                    ids = np.concatenate([ids, end])
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        own = ids[s : s + capacity]
                        rows.append((None if pd.isna(d) else int(d), p, s, len(own), digest(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    return own.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (``length`` in 1..capacity), which have ``_spread``, a number that tells even alike rows apart. ``pieces`` is read three times: materialize it."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table: dict[int, list] = defaultdict(list)
    for length, first, n, sequence, offset in plan(counts, capacity):
        table[length].append((first, sequence, offset))
    shared = spark.sparkContext.broadcast({k: tuple(np.array(c) for c in zip(*sorted(v), strict=True)) for k, v in table.items()})
    salts = F.get(F.lit([-(-counts.get(k, 1) // RANKED) for k in range(capacity + 1)]), F.col("length"))
    salted = pieces.withColumn("_salt", F.pmod("_spread", salts.cast("long")).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    firsts = parts.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_first"))
    # both sides are dealt by length and salt already
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))

    def look_up(batches):
        for frame in batches:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, at in frame.groupby("length").indices.items():
                first, seq, off = shared.value[length]
                rank = frame["_rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, side="right") - 1
                sequence[at], offset[at] = seq[i] + rank - first[i], off[i]
            frame = frame.drop(columns="_rank")
            frame["sequence_id"], frame["offset"] = sequence, offset
            yield frame

    own = pieces.drop("_spread")
    fields = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    return ranked.select(*own.columns, "_rank").mapInPandas(look_up, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack whole documents (see ``token_pieces`` and ``place``); an empty table gives no rows."""
    pieces = token_pieces(docs, capacity, path)
    spread = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())
    return place(materialize(pieces.withColumn("_spread", spread), "pieces"), capacity)
