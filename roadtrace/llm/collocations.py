"""Phrase collocations from count streams in prefix and suffix order, merged in lockstep.

1. Tasks count the word runs (up to ``max_words``) of their texts; Spark sums them. Only
   runs of at least ``min_count`` occurrences go on: no part of a phrase is rarer than the
   phrase, so every count that is asked for is among them. For the same reason runs of
   three words and more are counted in a pass of their own, without those that
   a filter of fixed size over the frequent runs of a word less rules out.
2. The counts are sorted by their words (prefix order). There the streams of all lengths
   run in lockstep: the words of a language (a run of no words, their number), then a
   word, the pairs that begin with it, and below each pair the triples that begin with
   it. One pass hands each run the counts of its beginnings and its most frequent
   extension to the right.
3. Sorted by the reversed words (suffix order), the same pass gives the counts of a run's
   ends and its most frequent extension to the left.

No table is probed by a hash of a phrase in 2 and 3; both are range-partitioned sorts. A
range may begin anywhere, also among the pairs of a very frequent word: what is open at
its border (a count for each length) is handed on from range to range.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.llm.kernels import mix, shingle_hashes, span_hashes
from roadtrace.llm.storage import materialize, small_batches

MAX_WORDS, MIN_COUNT, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Words that a task holds before it counts their runs, and runs in a batch of counts.
HELD_TOKENS, BATCH_RUNS = 4_000_000, 50_000
#: Bits of the filter that is broadcast (16 MB); of more than an eighth of that many frequent runs it lets more and more others through, which are counted and dropped then.
FILTER_BITS = 1 << 27
#: A task ranks at most so many times ``top`` phrases of a language.
RANKED = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_END, _BETWEEN = b".", b" . "


def _run_hashes(words: list[bytes], own: np.ndarray, k: int, lang: str) -> np.ndarray:
    """Hash of the k words (numbers in ``words``) that start at each place of ``own``."""
    ends = np.cumsum([len(w) for w in words])
    hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    return mix(shingle_hashes(hashes[own], k) ^ np.uint64(zlib.crc32(lang.encode())))


def frequent_filter(runs: DataFrame, k: int) -> np.ndarray:
    """Bits at the hashes of all ``runs`` (lang, phrase) of k words: at least 16 for each run while ``FILTER_BITS`` allow, as bytes of at most an eighth of that.

    A run that isn't there may find its bit set by another; so it lets through, and loses nothing.
    """
    bits = min(FILTER_BITS, 1 << max(10, (16 * runs.count()).bit_length()))

    def place(batches):
        for batch in batches:
            for lang, own in batch.to_pandas().groupby("lang"):
                words = [w for p in own["phrase"] for w in p.encode().split(b" ")]
                h = _run_hashes(words, np.arange(len(words)), k, lang)[::k] % np.uint64(bits)
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(3)).astype(np.int64)), pa.array((1 << (h & np.uint64(7)).astype(np.int64)))], names=["at", "bit"])

    found = runs.select("lang", "phrase").mapInArrow(place, "at long, bit long").groupBy("at").agg(F.bit_or("bit").cast("short").alias("byte")).toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    out[found.column("at").to_numpy()] = found.column("byte").to_numpy().astype(np.uint8)
    return out


def run_counts(docs: DataFrame, first: int, last: int, allowed: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, c): occurrences of each run of ``first`` to ``last`` words within a piece; with ``first`` 1 the empty phrase counts all words.

    ``allowed`` is the ``frequent_filter`` of runs of ``last`` - 1 words: runs of which a part isn't in it are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = None if allowed is None else spark.sparkContext.broadcast(allowed)

    def flush(lang: str, ids: dict, parts: list[np.ndarray]):
        """Counts of the runs of one language; a run is told by the place of its beginning among the shorter ones, and its last word."""
        own = np.concatenate(parts).astype(np.int64)
        words = pa.array(list(ids), pa.binary())
        start, found, run, runs = np.flatnonzero(own), [], words, own
        if shared is not None:
            h = _run_hashes(list(ids), own, last - 1, lang) % np.uint64(8 * len(shared.value))
            there = (shared.value[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            start = np.flatnonzero(there[:-1] & there[1:] & (own[: max(0, len(there) - 1)] > 0))
        if first == 1:
            n = np.bincount(own)
            found = [(pa.array([b""], pa.binary()), np.array([n[1:].sum()])), (words.slice(1), n[1:])]
        for k in range(1, last):  # runs: for each token, the place of the run of k words that starts there
            start = start[start + k < len(own)]
            start = start[own[start + k] > 0]
            codes, inverse, n = np.unique(runs[start] << 32 | own[start + k], return_inverse=True, return_counts=True)
            run = pc.binary_join_element_wise(run.take(pa.array(codes >> 32)), words.take(pa.array(codes & (2**32 - 1))), b" ")
            if k + 1 >= first:
                found.append((run, n))
            if k + 1 < last:
                runs = np.zeros(len(own), np.int64)
                runs[start] = inverse
        for phrases, n in found:
            for i in range(0, len(phrases), BATCH_RUNS):
                part = phrases.slice(i, BATCH_RUNS).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), part, pa.array(n[i : i + BATCH_RUNS])], names=["lang", "phrase", "c"])

    def count(batches):
        held: dict = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held:
                    ids = defaultdict(itertools.count().__next__)
                    held[lang] = ids, [np.full(1, ids[_END], np.int32)]
                ids, parts = held[lang]
                tokens = _ENDS.sub(_BETWEEN, (text or b"").translate(_LOWER)).split()  # the blanks that are left are space and tab
                tokens.append(_END)
                parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                n += len(tokens)
                if n >= HELD_TOKENS:
                    for own in [*held]:
                        yield from flush(own, *held.pop(own))
                    n = 0
        for own in [*held]:
            yield from flush(own, *held.pop(own))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    # tasks have added up what they could, so rows go straight to the shuffle
    return rows.mapInArrow(count, "lang string, phrase string, c long").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def frequent_runs(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, c) of all runs of at least ``min_count`` occurrences, and all words of each language as the run of none.

    Words and pairs are counted at once; each longer length takes another pass, in
    which only runs whose both parts of a word less may be frequent are counted.
    """
    found, k = None, 2
    while k <= max_words:
        allowed = frequent_filter(found.where(F.size(F.split("phrase", " ")) == k - 1), k - 1) if found else None
        counts = run_counts(docs, k if found else 1, k, allowed)
        counts = materialize(counts.where((F.col("c") >= min_count) | (F.col("phrase") == "")), "counts")
        found = found.unionByName(counts) if found else counts
        k += 1
    words = F.when(F.col("phrase") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("phrase", " "))
    return found.select("lang", words.alias("words"), "c")


def lockstep(counts: DataFrame, key: Column, max_words: int, before: str, extension: str) -> DataFrame:
    """Add two columns to ``counts`` (lang, words, c, ...): in ``before`` at place j the count of the first j words of ``key`` (0: all words of the language), in ``extension`` the largest count of a run that adds a word behind them.

    All beginnings of a run must be among the rows.
    """
    spark, fields = counts.sparkSession, counts.columns
    levels = range(max_words)

    def merge(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def out(batch, f, ext, is_open):
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * max_words), pa.array(f.ravel(), mask=f.ravel() < 0))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], lists, pa.array(ext, mask=ext < 0), pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, is_open))], names=[*fields, "_f", "_e", "_p", "_open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            f, ext = np.full((batch.num_rows, max_words), -1, np.int64), np.full(batch.num_rows, -1, np.int64)
            if held is not None:  # the open run of each length goes before the batch
                batch = pa.concat_batches([held[0], batch])
                f, ext = np.concatenate([held[1], f]), np.concatenate([held[2], ext])
            size, c = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("_size", "c"))
            place, is_open = np.arange(len(size)), np.zeros(len(size), bool)
            for j in levels:
                last = np.maximum.accumulate(np.where(size == j, place, -1))
                inner = (size > j) & (last >= 0)
                f[inner, j] = c[last[inner]]
                longer = (size == j + 1) & (last >= 0)
                np.maximum.at(ext, last[longer], c[longer])
                if last[-1] >= 0 and not (size[last[-1] + 1 :] <= j).any():
                    is_open[last[-1]] = True
            done, stay = pa.array(np.flatnonzero(~is_open)), np.flatnonzero(is_open)
            yield out(batch.take(done), f[~is_open], ext[~is_open], False)
            held = batch.take(pa.array(stay)), f[stay], ext[stay]
        if held is not None and held[0].num_rows:
            yield out(*held, True)

    types = dict(counts.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in fields) + ", _f array<long>, _e long, _p long, _open boolean"
    ordered = counts.withColumns({"_size": F.size("words"), "_key": key}).repartitionByRange("lang", "_key").sortWithinPartitions("lang", "_key")
    merged = materialize(ordered.select(*fields, "_size").mapInArrow(merge, schema), "merged")
    size = F.size("words")
    of = lambda j, value, cond: F.max(F.when(cond, value)).alias(f"{j}")
    border = merged.groupBy("_p").agg(
        F.array(*[of(j, F.col("c"), F.col("_open") & (size == j)) for j in levels]).alias("last"),
        F.array(*[of(j, F.col("c"), (size == j + 1) & F.get("_f", F.lit(j)).isNull()) for j in levels]).alias("lead"),
        F.array(*[F.coalesce(F.bool_or(size <= j), F.lit(False)) for j in levels]).alias("closed"),
    ).orderBy("_p").collect()  # one row for each range
    starts, now = [], [None] * max_words
    for r in border:
        starts.append(now)
        now = [r["last"][j] if r["closed"][j] else now[j] for j in levels]
    tails, behind = [], [None] * max_words
    for r in reversed(border):
        tails.append(behind)
        behind = [max((x for x in (r["lead"][j], None if r["closed"][j] else behind[j]) if x is not None), default=None) for j in levels]
    known = spark.createDataFrame([(r["_p"], s, t) for r, s, t in zip(border, starts, reversed(tails), strict=True)], "_p long, _start array<long>, _tail array<long>")
    joined = merged.join(F.broadcast(known), "_p")
    full = F.transform("_f", lambda x, j: F.when(j < F.size("words"), F.coalesce(x, F.get("_start", j))))
    return joined.select(*fields, full.alias(before), F.greatest("_e", F.when(F.col("_open"), F.get("_tail", size))).alias(extension))


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang by score, a (descending) and phrase, with their rank. Many phrases of one language are ranked in parts first, whose best go on."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while True:
        most = rows.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
        parts = -(-most // (RANKED * top))
        if parts <= 1:
            return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        ranked = rows.withColumn("_part", part).withColumn("_r", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order)))
        rows = materialize(ranked.where(F.col("_r") <= top).drop("_part", "_r"), "ranked")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``max_words`` words of each language.

    A phrase occurs ``a`` >= ``min_count`` times. Of its cuts in two the one of least
    floor(10^6 a^2 / (l r)) counts, ties to the earlier cut; l and r are the
    occurrences of the parts, n the words of the language. A phrase is left out where
    a longer one that holds it has at least ``inside_percent`` per cent of its
    occurrences (one with a word more at either side is never rarer than longer ones).

    A null lang is ``und``, a null text is empty, repeated rows count each time, and
    doc_id is not looked at. An empty table gives no rows. Counts must stay below 10^15.
    """
    counts = frequent_runs(docs, max_words, min_count)
    counts = lockstep(counts, F.col("words"), max_words, "first", "right")
    counts = lockstep(counts, F.reverse("words"), max_words, "last", "left")
    big = lambda x: f"cast({x} as decimal(15, 0))"
    score = f"cast({big('c')} * {big('c')} * 1000000 div ({big('first[k]')} * {big('last[size(words) - k]')}) as long)"
    cut = F.expr(f"array_min(transform(sequence(1, size(words) - 1), k -> named_struct('score', {score}, 'k', k, 'l', first[k], 'r', last[size(words) - k])))")
    longer = F.coalesce(F.greatest("left", "right"), F.lit(0))
    found = counts.where((F.size("words") >= 2) & (longer * 100 < F.col("c") * inside_percent)).withColumn("cut", cut)
    found = found.select("lang", F.array_join("words", " ").alias("phrase"), F.col("c").alias("a"), "cut.l", "cut.r", F.get("first", F.lit(0)).alias("n"), "cut.score")
    found = materialize(found, "found")
    return best(found, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The rows of ``collocations`` with its defaults.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1
), runs AS (
  SELECT lang, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase, list_slice(w, s, s + size - 1) AS x
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM words, (SELECT unnest([1, 2, 3]) AS size) z WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, any_value(x) AS x, count(*) AS c FROM runs GROUP BY lang, size, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT p.lang, p.phrase, p.size, p.c AS a, k, l.c AS l, r.c AS r, CAST(1000000::HUGEINT * p.c * p.c // (l.c::HUGEINT * r.c) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) p
  JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(list_slice(p.x, 1, k), ' ')
  JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(list_slice(p.x, k + 1, p.size), ' ')
), scored AS (
  SELECT lang, phrase, size, a, min_by(l, score * 10 + k) AS l, min_by(r, score * 10 + k) AS r, min(score) AS score FROM cuts GROUP BY lang, phrase, size, a
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = s.lang AND b.size = 3 AND s.size = 2 AND 100 * b.c >= 50 * s.a AND s.phrase IN (array_to_string(list_slice(b.x, 1, 2), ' '), array_to_string(list_slice(b.x, 2, 3), ' ')))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
