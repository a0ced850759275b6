"""Lines repeated across documents, dropped by probing a sharded minimal perfect hash.

Documents give a 128-bit hash for each distinct line key; Spark sums in how many
documents each occurs. An exact filter comes before the index: a key of fewer than
``index_from`` documents (by default ``min_docs``) can never be dropped, so it is
left out, and the index grows with the lines that repeat, not with all lines. The
other distinct hashes are split into shards, and each shard's task builds a minimal
perfect hash over them with a fingerprint array (48 bits a key) and a count array
(16 bits, the most it can hold standing for more). Tasks then read the arrays from
the shared folder and probe them with the hashes of their lines: a line goes if its
fingerprint is there and its count reaches ``min_docs``; no line is joined.

At most ``resident`` keys are held by a worker at once. Beside a larger index the lines'
hashes are dealt out by shard, probed there, and only those that go come back to their texts;
the number of passes does not depend on the index.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.kernels import chunks, mix, span_hashes
from roadtrace.llm.storage import join_hot, materialize, open_fs, small_batches

MIN_DOCS, MIN_CHARS = 10, 1
SHARD_KEYS, RESIDENT_KEYS = 250_000, 4_000_000
#: The largest number of documents that a count can say.
MOST = 65_535
_GAMMA, _LEVELS = 2, 48
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Lines:
    """Lines of several texts (bounds[i]:bounds[i + 1] are those of text i), with two hashes of each key and its code points (0: blank)."""

    def __init__(self, texts: list):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join([*raw, b""])
        a = np.frombuffer(self.data.translate(_LOWER), np.uint8)
        self.ends = np.flatnonzero(a == 10)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        stops = np.cumsum([len(r) + 1 for r in raw])
        self.bounds = np.concatenate([[0], np.searchsorted(self.ends, stops - 1) + 1])
        solid = np.flatnonzero(~_SPACE[a])
        i, j = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        some = j > i
        solid = np.concatenate([solid, [0]])
        start, end = np.where(some, solid[i], 0), np.where(some, solid[j - 1] + 1, 0)
        points = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
        self.n_points = points[end] - points[start]
        self.keys = span_hashes(a, start, end)
        table = mix(np.arange(256, dtype=np.uint64), 99)
        self.prints = span_hashes(table[a], start, end)


def line_counts(docs: DataFrame, index_from: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, print, n): line hashes found in at least ``index_from`` rows. Each task adds its rows up before the shuffle."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                lines = Lines(texts[a:b])
                doc = np.repeat(np.arange(b - a), np.diff(lines.bounds))
                ok = lines.n_points >= min_chars
                keys, prints, doc = lines.keys[ok], lines.prints[ok], doc[ok]
                order = np.lexsort((doc, prints, keys))
                keys, prints, doc = keys[order], prints[order], doc[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
                first = new.copy()
                first[1:] |= doc[1:] != doc[:-1]
                n = np.add.reduceat(first, np.flatnonzero(new)) if len(keys) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(prints[new].view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "print", "n"])

    rows = docs.select("text").mapInArrow(count, "key long, print long, n long")
    return rows.groupBy("key", "print").agg(F.sum("n").alias("n")).where(F.col("n") >= index_from)


class PerfectHash:
    """Minimal perfect hash in levels: at each one the keys that are alone at their place are settled, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits as uint64 words
        self.ranks, before = [], 0
        for words in levels:
            ones = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.ranks.append(np.concatenate([[before], before + ones]))
            before += int(ones[-1]) if len(ones) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(_LEVELS):
            if not len(keys):
                break
            n = -(-_GAMMA * len(keys) // 64) * 64
            at = (mix(keys, level + 1) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            levels.append(words)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys of a shard are not distinct")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; some index or -1 for a key that isn't in the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (mix(keys[left], level + 1) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = ranks[word[here]] + np.bitwise_count(below)
            left = left[~here]
        return out


def _pack(prints: np.ndarray) -> tuple[bytes, bytes]:
    """The low 48 bits of fingerprints as arrays of 32 and 16 bits."""
    return prints.astype("<u4").tobytes(), (prints >> np.uint64(32)).astype("<u2").tobytes()


def build_index(counts: DataFrame, total: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard: shard, sizes of the levels, their bits, and at the keys' indexes the fingerprints (low, high) and counts."""
    shards = max(1, -(-total // shard_keys))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["key"].to_numpy().view(np.uint64)
        # two keys of one 64-bit hash but different fingerprints: the index takes the first, the rest goes to its own list
        unique, first = np.unique(keys, return_index=True)
        spare = frame.drop(frame.index[first])
        h = PerfectHash.build(unique)
        at = h.find(unique)
        prints, n = np.zeros(len(at), np.uint64), np.zeros(len(at), "<u2")
        prints[at], n[at] = frame["print"].to_numpy()[first].view(np.uint64), np.minimum(frame["n"].to_numpy()[first], MOST)
        low, high = _pack(prints)
        return pd.DataFrame({
            "shard": [int(frame["shard"].iloc[0])], "sizes": [[len(w) for w in h.levels]],
            "bits": [b"".join(w.tobytes() for w in h.levels)], "low": [low], "high": [high], "counts": [n.tobytes()],
            "spare": [np.concatenate([spare[c].to_numpy(np.int64) for c in ("key", "print", "n")]).tobytes()],
        })

    sharded = counts.withColumn("shard", F.pmod(F.shiftright("key", 7), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(build, "shard int, sizes array<int>, bits binary, low binary, high binary, counts binary, spare binary")


class Shard:
    def __init__(self, row: dict):
        words = np.frombuffer(row["bits"], np.uint64)
        self.hash = PerfectHash(np.split(words, np.cumsum(row["sizes"])[:-1]))
        self.low, self.high, self.n = np.frombuffer(row["low"], "<u4"), np.frombuffer(row["high"], "<u2"), np.frombuffer(row["counts"], "<u2")
        spare = np.split(np.frombuffer(row["spare"], np.int64), 3)
        self.spare = dict(zip(zip(spare[0].view(np.uint64), spare[1].view(np.uint64), strict=True), spare[2], strict=True))

    def counts(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """In how many documents each key occurs, at most ``MOST``; 0 where its fingerprint is not there."""
        at = self.hash.find(keys)
        hit = (at >= 0) & (self.low[at] == prints.astype("<u4")) & (self.high[at] == (prints >> np.uint64(32)).astype("<u2"))
        out = np.where(hit, self.n[at], 0).astype(np.int64)
        if self.spare:
            out = np.maximum(out, [self.spare.get(x, 0) for x in zip(keys, prints, strict=True)])
        return out


@functools.lru_cache(maxsize=1)
def _load(path: str) -> dict[int, Shard]:
    """All shards, read from the index files."""
    import pyarrow.dataset as ds

    fs, inner = open_fs(path)
    return {r["shard"]: Shard(r) for batch in ds.dataset(inner, filesystem=fs, format="parquet").to_batches(batch_size=1) for r in batch.to_pylist()}


@functools.lru_cache(maxsize=2)
def _load_one(path: str, shard: int) -> Shard:
    import pyarrow.dataset as ds

    fs, inner = open_fs(path)
    return Shard(ds.dataset(inner, filesystem=fs, format="parquet").to_table(filter=ds.field("shard") == shard).to_pylist()[0])


def _repeated(lines: Lines, shards: dict[int, Shard], n_shards: int, min_docs: int, min_chars: int) -> np.ndarray:
    """Whether each line's key is in the loaded shards with a count of ``min_docs`` or more."""
    out = np.zeros(len(lines.keys), bool)
    shard = (lines.keys.view(np.int64) >> 7) % n_shards
    for s, own in shards.items():
        at = np.flatnonzero((shard == s) & (lines.n_points >= min_chars))
        out[at] = own.counts(lines.keys[at], lines.prints[at]) >= min_docs
    return out


def _without(lines: Lines, drop: np.ndarray, texts: list) -> list[str]:
    """The texts without the lines of ``drop``, in one pass over their bytes."""
    n_dropped = np.add.reduceat(drop, lines.bounds[:-1]).tolist()
    if not any(n_dropped):
        return [t or "" for t in texts]
    size = lines.ends - lines.starts + 1  # with the line's end
    left = np.frombuffer(lines.data, np.uint8)[np.repeat(~drop, size)].tobytes()
    stops = np.cumsum(np.add.reduceat(np.where(drop, 0, size), lines.bounds[:-1])).tolist()
    return [left[a : max(a, b - 1)].decode("utf-8", "surrogatepass") if n else t or "" for a, b, n, t in zip([0, *stops], stops, n_dropped, texts, strict=False)]


#: Tasks that the lines of one shard are dealt to.
SALTS = 64


def _dropped_by_shard(docs: DataFrame, path: str, n_shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """_t (digest of a text), rows (with that text) and drop (key and fingerprint of each of its lines that goes), for texts that lose one.

    Lines go to the tasks of their shards, each of which loads that shard alone; only what
    goes comes back. So texts are read, but not written, whatever the size of the index.
    """

    def lines_of(batches):
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                lines = Lines(texts[a:b])
                doc = np.repeat(np.arange(a, b), np.diff(lines.bounds))
                ok = np.flatnonzero(lines.n_points >= min_chars)
                once = np.unique(np.rec.fromarrays([doc[ok], lines.keys[ok], lines.prints[ok]], names="doc,key,print"))
                keys = once.key.view(np.int64)
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(once.doc)), pa.array(((keys >> 7) % n_shards).astype(np.int32)), pa.array(keys), pa.array(once.print.view(np.int64))], names=["_t", "shard", "key", "print"])

    def probe(batches):
        for batch in batches:
            shard, keys, prints = (batch.column(i).to_numpy() for i in (1, 2, 3))
            go = np.zeros(len(shard), bool)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                go[at] = _load_one(path, int(s)).counts(keys[at].view(np.uint64), prints[at].view(np.uint64)) >= min_docs
            yield batch.filter(pa.array(go))

    schema = "_t string, shard int, key long, print long"
    lines = docs.select("_t", "text").mapInArrow(lines_of, schema)
    dealt = lines.repartition("shard", F.pmod(F.xxhash64("_t"), F.lit(SALTS))).sortWithinPartitions("shard")
    found = dealt.mapInArrow(probe, schema).groupBy("_t").agg(F.collect_set(F.struct("key", "print")).alias("drop"))
    return found.join(docs.groupBy("_t").agg(F.count("*").alias("rows")), "_t")


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, resident: int = RESIDENT_KEYS, shard_keys: int = SHARD_KEYS, index_from: int | None = None) -> DataFrame:
    """All columns of ``docs`` in ``doc`` (struct), n_lines, n_dropped and ``kept``, the text of the lines that stay.

    A key is a line stripped of blanks at both ends, A-Z lower-cased; keys of at
    least ``min_chars`` code points in at least ``min_docs`` rows lose all their
    lines. A null or empty text is one empty line (and stays ''); repeated rows
    count as documents of their own; an empty table gives no rows. A text's cost
    is linear in its length, however many lines it has.
    """
    if min_docs > MOST:
        raise ValueError(f"counts are held up to {MOST} documents")
    small_batches(docs.sparkSession)
    counts = materialize(line_counts(docs, min_docs if index_from is None else min(index_from, min_docs), min_chars), "line-counts")
    total = counts.count()
    n_shards = max(1, -(-total // shard_keys))
    index = materialize(build_index(counts, total, shard_keys), "line-index")
    path = index.inputFiles()[0].rsplit("/", 1)[0] if total else None
    whole = total <= resident
    out = docs.select("text", F.struct("*").alias("doc"))
    if not whole:
        out = out.withColumn("_t", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        found = materialize(_dropped_by_shard(out, path, n_shards, min_docs, min_chars), "line-drops")
        out = join_hot(out, found, "_t", "rows", found.agg(F.sum("rows")).head()[0] or 0, ["drop"])
        out = out.select("text", "doc", F.transform("drop", lambda x: x["key"]).alias("keys"), F.transform("drop", lambda x: x["print"]).alias("prints"))

    def finish(batches):
        shards = _load(path) if whole and path is not None else {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for a, b in chunks(texts):
                lines = Lines(texts[a:b])
                if whole:
                    drop = _repeated(lines, shards, n_shards, min_docs, min_chars)
                else:
                    drop = np.zeros(len(lines.keys), bool)
                    for d in range(b - a):
                        keys, prints = (batch.column(c)[a + d].values for c in ("keys", "prints"))
                        if keys is not None and len(keys):
                            at = slice(lines.bounds[d], lines.bounds[d + 1])
                            drop[at] = np.isin(lines.keys[at].view(np.int64), keys.to_numpy()) & np.isin(lines.prints[at].view(np.int64), prints.to_numpy()) & (lines.n_points[at] >= min_chars)
                n_lines += np.diff(lines.bounds).tolist()
                n_dropped += np.add.reduceat(drop.astype(np.int64), lines.bounds[:-1]).tolist()
                kept += _without(lines, drop, texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_lines", "n_dropped", "kept"])

    return out.mapInArrow(finish, f"doc {out.schema['doc'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def summary(dropped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``drop_repeated_lines``'s rows."""
    return dropped.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
