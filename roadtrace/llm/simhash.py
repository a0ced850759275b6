"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are single words and pairs of neighbouring words. Each occurrence votes on
the signed bits of its hash with a weight that grows with the term's length, for
long terms are rare ones; so repeated terms count as often as they occur.

The search cuts the 64 bits into ``blocks`` blocks. Fingerprints that differ in at
most ``radius`` bits agree on at least blocks - radius of them, so for each choice
of that many blocks there is a table keyed by them (the permuted tables), and an
equi-join on the key finds all pairs. Equal fingerprints are joined once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm import ranges
from roadtrace.llm.kernels import Words, chunks, mix
from roadtrace.llm.storage import BATCH_ROWS, join_hot, materialize, small_batches

BITS, RADIUS, BLOCKS = 64, 3, 6
#: Weight of a word by its bytes, and the rows of terms that vote at once.
LONGEST, _STEP = 16, 1 << 15


def _vote(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of signed bits [text, 64] of the terms bounds[i]:bounds[i + 1] of each text."""
    votes = np.zeros((len(bounds) - 1, BITS))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(hashes), _STEP):
        b = min(a + _STEP, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        bits = (2 * bits - 1) * weights[a:b, None].astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
        votes[doc[a:b][first]] += np.add.reduceat(bits, first, axis=0)
    return votes


def fingerprints(texts: list) -> np.ndarray:
    """64-bit fingerprints; a text without words has 0."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        if not len(w.hashes):
            continue
        weight = np.minimum(w.lengths, LONGEST).astype(np.float64)
        votes = _vote(mix(w.hashes, 3), weight, w.bounds)
        if len(w.hashes) > 1:
            pairs = mix(w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[1:], 5)
            doc = np.repeat(np.arange(b - a), np.diff(w.bounds))
            own = doc[1:] == doc[:-1]
            n = np.bincount(doc[1:][own], minlength=b - a)
            votes += _vote(pairs[own], (weight[:-1] + weight[1:])[own], np.concatenate([[0], np.cumsum(n)]))
        powers = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        out[a:b] = ((votes > 0) * powers).sum(axis=1, dtype=np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long); null and wordless texts have 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = fingerprints(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def permuted_keys(fp: str = "fp", radius: int = RADIUS, blocks: int = BLOCKS):
    """Array column of the tables' keys of a fingerprint: (table, agreeing blocks' bits)."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(signed)).alias("k")))
    return F.array(*keys)


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (query_fp, fp, distance) with distance <= radius; both inputs have distinct values in ``fp``."""
    q = queries.select(F.col("fp").alias("query_fp"), F.explode(permuted_keys("fp", radius, blocks)).alias("key"))
    p = prints.select("fp", F.explode(permuted_keys("fp", radius, blocks)).alias("key"))
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))).cast("int")
    pairs = q.join(p, "key").withColumn("distance", distance).where(F.col("distance") <= radius)
    return pairs.select("query_fp", "fp", "distance").distinct()


def near_counts(prints: DataFrame, every: int = 100, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, n_near and n_asked for the fingerprints of rows whose id is divisible by ``every``: rows of all of ``prints`` within the radius, and rows that ask."""
    asks = F.pmod("doc_id", F.lit(every)) == 0
    weights = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.count_if(asks).alias("n_asked")), "prints")
    asked = weights.where("n_asked > 0")
    pairs = within_radius(asked, weights, radius, blocks)
    near = pairs.join(weights.select("fp", "n"), "fp").groupBy(F.col("query_fp").alias("fp")).agg(F.sum("n").alias("n_near"))
    return near.join(asked.select("fp", "n_asked"), "fp")


def edited_fingerprints(docs: DataFrame, per_task: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many of the next row's text, in ascending doc_id (nulls first, equal
    ids by text; after the last row the first). A null text is empty; other columns
    are ignored. Rows are dealt out in ranges of about ``per_task`` bytes
    (``ranges``); the first rows of a range also go to the range before it.
    """
    import hashlib

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    parts = ranges.cut(rows, "_id", ["_text"], F.octet_length("_text"), per_task)
    dealt = ranges.deal(rows, parts, "_id", ["_text"], tails=True)

    def run(batches):
        held = None  # the last own row (id, text, copies); its next row follows in the order of the part
        skip = None  # part whose tail is done
        for batch in batches:
            own, nexts, many = [], [], []
            for i, t, n, part, tail in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if tail and skip == part:
                    continue
                if held is not None:
                    own.append(held)
                    nexts.append(t)
                    many.append(1)
                held, skip = (None, part) if tail else ((i, t), skip)
                if n > 1 and not tail:  # alike rows follow one another
                    own.append(held)
                    nexts.append(t)
                    many.append(n - 1)
            if own:
                out = _pairs(own, nexts)
                if len(many) == sum(many):
                    yield out
                else:
                    for first in range(0, sum(many), BATCH_ROWS):
                        at = np.searchsorted(np.cumsum(many), np.arange(first, min(first + BATCH_ROWS, sum(many))), side="right")
                        yield out.take(pa.array(at))

    def _pairs(own, nexts):
        texts = [t for _, t in own]
        edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts, strict=True)]
        fp, fe = fingerprints(texts), fingerprints(edited)
        follow = fingerprints(nexts[-1:])
        # the next of all but the last pair is mostly the next own text
        fn = np.concatenate([fp[1:], follow])
        for j in range(len(texts) - 1):
            if nexts[j] is not texts[j + 1] and nexts[j] != texts[j + 1]:
                fn[j] = fingerprints([nexts[j]])[0]
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(fp.view(np.int64)), pa.array(fe.view(np.int64)), pa.array(likeness(fp, fe)), pa.array(likeness(fp, fn)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"])

    return dealt.select("_id", "_text", "_n", "_part", "_tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double")


def summary(edited: DataFrame) -> DataFrame:
    """The contract's columns and n_near: for rows whose id is divisible by 100, the rows of all within the radius of its fingerprint (else null)."""
    prints = materialize(edited, "fingerprints")
    near = materialize(near_counts(prints.select("doc_id", "fp")), "near")
    code = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    asks = prints.where(F.pmod("doc_id", F.lit(100)) == 0)
    # one fingerprint may be that of many rows
    asked = join_hot(asks, near, "fp", "n_asked", near.agg(F.sum("n_asked")).head()[0] or 0, ["n_near"])
    rest = prints.where(F.coalesce(F.pmod("doc_id", F.lit(100)) != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    rows = rest.unionByName(asked)
    return rows.select("doc_id", "n_chars", "edited_sha256", code("fp").alias("fingerprint"), code("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
