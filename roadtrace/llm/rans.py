"""Token-id files by a static range asymmetric numeral system (rANS).

A file holds the ids of a range of documents in ascending ``doc_id`` order. Its
frequency table is shared by all its blocks; a block is coded on its own by
``LANES`` interleaved states, and its index entry (the checkpoint) holds where
its words begin, its count of ids and a crc32, so blocks are decoded in parallel
or singly. Layout: magic, header length, JSON header, then zlib-packed sections
(table, document index, block index) and the blocks.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.llm import ranges
from roadtrace.llm.kernels import chunks
from roadtrace.llm.storage import materialize, read_file, shared_folder, small_batches, write_committed
from roadtrace.llm.tokens import END_ID, digest, tokenizer_path, worker_tokenizer

MAGIC = b"RTANS1\n\0"
SCALE = 20
LANES, STEPS = 64, 1024
BLOCK = LANES * STEPS
_LOW = np.uint64(1 << 31)
#: Blocks coded together; bounds the scratch arrays to some tens of MB.
GROUP = 64


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each id that occurs."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint32)
    if not len(used):
        out[0] = 1 << SCALE
        return out
    if len(used) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} distinct ids in a file")
    c = counts[used].astype(np.float64)
    f = np.maximum(1, np.floor(c / c.sum() * (1 << SCALE))).astype(np.int64)
    rest = (1 << SCALE) - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if rest >= 0:
        f[order[0]] += rest
    for i in order:  # few steps: the commonest ids give the most
        if rest >= 0:
            break
        take = min(-rest, int(f[i]) // 2)
        f[i] -= take
        rest += take
    out[used] = f
    return out


def _encode_blocks(ids: np.ndarray, steps: int, freq: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Code whole blocks, each LANES * steps ids; all lanes of all blocks step together, last id first."""
    n = len(ids) // (LANES * steps)
    lanes = ids.reshape(n, steps, LANES).transpose(1, 0, 2).reshape(steps, n * LANES)
    x = np.full(n * LANES, _LOW, np.uint64)
    words = np.zeros((steps, n * LANES), np.uint32)
    sent = np.zeros((steps, n * LANES), bool)
    f_all, s_all = freq.astype(np.uint64), start.astype(np.uint64)
    shift, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        f = f_all[lanes[t]]
        full = x >= f << np.uint64(63 - SCALE)
        sent[t] = full
        words[t] = x & low32
        x = np.where(full, x >> shift, x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + s_all[lanes[t]]
    out = []
    for b in range(n):
        own = slice(b * LANES, (b + 1) * LANES)
        out.append(x[own].astype("<u8").tobytes() + words[:, own][sent[:, own]].astype("<u4").tobytes())
    return out


def _decode_blocks(blocks: list[bytes], steps: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    n = len(blocks)
    x = np.concatenate([np.frombuffer(b, "<u8", LANES) for b in blocks]).astype(np.uint64)
    parts = [np.frombuffer(b, "<u4", offset=8 * LANES) for b in blocks]
    pointer = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    words = np.concatenate([*parts, np.zeros(1, np.uint32)]).astype(np.uint64)
    out = np.zeros((steps, n * LANES), np.int32)
    mask, f_all, s_all = np.uint64((1 << SCALE) - 1), freq.astype(np.uint64), start.astype(np.uint64)
    for t in range(steps):
        slot = x & mask
        s = symbol[slot.astype(np.int64)]
        out[t] = s
        x = f_all[s] * (x >> np.uint64(SCALE)) + slot - s_all[s]
        need = (x < _LOW).reshape(n, LANES)
        if need.any():
            ranks = np.cumsum(need, axis=1)
            at = (ranks - 1 + pointer[:, None])[need]
            flat = need.reshape(-1)
            x[flat] = (x[flat] << np.uint64(32)) | words[at]
            pointer = pointer + ranks[:, -1]
    if (x != _LOW).any() or (pointer != np.cumsum([len(p) for p in parts])).any():
        raise ValueError("a block is damaged")  # the states end where the encoder began
    return out.reshape(steps, n, LANES).transpose(1, 0, 2).reshape(-1)


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(freq.astype(np.int64))[:-1]])


def encode_file(ids: np.ndarray, docs: list, counts: np.ndarray) -> bytes:
    """The bytes of a file of ``ids``, the concatenated documents ``docs`` (ids or None) of ``counts`` ids each."""
    hist = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    freq = frequency_table(hist)
    start = _starts(freq)
    blocks, n_full = [], len(ids) // BLOCK
    for a in range(0, n_full, GROUP):
        blocks += _encode_blocks(ids[a * BLOCK : min(a + GROUP, n_full) * BLOCK], STEPS, freq, start)
    rest = ids[n_full * BLOCK :]
    if len(rest):
        steps = -(-len(rest) // LANES)
        padded = np.full(steps * LANES, int(np.argmax(freq)), rest.dtype)
        padded[: len(rest)] = rest
        blocks += _encode_blocks(padded, steps, freq, start)
    known = np.array([d is not None for d in docs], np.uint8)
    doc_ids = np.array([d if d is not None else 0 for d in docs], "<i8")
    sizes = np.array([len(b) for b in blocks], "<u4")
    sums = np.array([digest(ids[i * BLOCK : (i + 1) * BLOCK]) for i in range(len(blocks))], "<u4")
    used = np.flatnonzero(freq)
    sections = [
        zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + freq[used].astype("<u4").tobytes(), 6),
        zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + known.tobytes() + np.asarray(counts, "<i8").tobytes(), 6),
        sizes.tobytes() + sums.tobytes(),
    ]
    header = json.dumps({"n_ids": len(ids), "n_docs": len(docs), "n_blocks": len(blocks), "n_used": len(used), "vocab": len(freq), "sections": [len(s) for s in sections]}).encode()
    body = [MAGIC, len(header).to_bytes(4, "little"), header, *sections, *blocks]
    return b"".join(body) + zlib.crc32(b"".join(sections)).to_bytes(4, "little")


class TokenFile:
    """Reads a file; ``ids(first, count)`` decodes any range of blocks from their checkpoints."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(data[8:12], "little")
        h = self.header = json.loads(data[12 : 12 + n])
        at, parts = 12 + n, []
        for size in h["sections"]:
            parts.append(data[at : at + size])
            at += size
        if zlib.crc32(b"".join(parts)) != int.from_bytes(data[-4:], "little"):
            raise ValueError("token file index is damaged")
        table = np.frombuffer(zlib.decompress(parts[0]), "<u4")
        self.freq = np.zeros(h["vocab"], np.uint32)
        self.freq[np.cumsum(table[: h["n_used"]])] = table[h["n_used"] :]
        index, m = zlib.decompress(parts[1]), h["n_docs"]
        known = np.frombuffer(index, np.uint8, m, 8 * m)
        values = np.cumsum(np.frombuffer(index, "<i8", m))
        self.docs = [int(v) if k else None for v, k in zip(values, known, strict=True)]
        self.counts = np.frombuffer(index, "<i8", m, 9 * m)
        sizes = np.frombuffer(parts[2], "<u4", h["n_blocks"])
        self.sums = np.frombuffer(parts[2], "<u4", h["n_blocks"], 4 * h["n_blocks"])
        self.offsets = at + np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.data = data
        self.start = _starts(self.freq)
        self.symbol = np.repeat(np.arange(h["vocab"], dtype=np.int32), self.freq)

    def ids(self, first: int = 0, count: int | None = None) -> np.ndarray:
        n = self.header["n_blocks"]
        last = n if count is None else min(n, first + count)
        tail = self.header["n_ids"] % BLOCK
        whole = n - 1 if tail else n
        out = []
        for a in range(first, min(last, whole), GROUP):
            b = min(a + GROUP, last, whole)
            out.append(_decode_blocks([self._block(i) for i in range(a, b)], STEPS, self.freq, self.start, self.symbol))
        if tail and last == n:
            out.append(_decode_blocks([self._block(n - 1)], -(-tail // LANES), self.freq, self.start, self.symbol)[:tail])
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        for i in range(first, last):
            if digest(ids[(i - first) * BLOCK : (i - first + 1) * BLOCK]) != self.sums[i]:
                raise ValueError(f"block {i} is damaged")
        return ids

    def _block(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


#: Files whose ids are summed up together before a file's first id is known.
_FILES_PER_BLOCK = 1000


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, per_file: int = 6 << 20) -> DataFrame:
    """Encode each text, append id 1, and write files of about ``per_file`` text bytes in ascending ``id_col`` order.

    A null text is empty; rows of a null id come first, rows of equal ids stay
    separate, in order of their text (within ranges of its hash, where they fill
    several files). Which rows a file holds depends on
    the rows alone (``ranges``). A task writes its file under a temporary name and
    renames it; the returned manifest (file, part, n_docs, n_ids) is the commit:
    only files it names are part of the data, so a repeated task does no harm.
    An empty table gives an empty manifest. Other columns are ignored.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    parts = ranges.cut(docs, "_id", ["_text"], F.octet_length("_text"), per_file)
    dealt = ranges.deal(docs, parts, "_id", ["_text"]).select("_id", "_text", "_n", "_part")

    def encode(batches):
        tokenizer = worker_tokenizer(path)
        end = np.array([END_ID], tokenizer.dtype)
        part, ids, names, counts = None, [], [], []

        def commit():
            name, everything = f"{folder}/part-{part:07d}.rans", np.concatenate(ids)
            write_committed(name, [encode_file(everything, names, np.array(counts))])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(everything)], pa.int64())], names=["file", "part", "n_docs", "n_ids"])

        for batch in batches:
            keys, texts, many, own = (batch.column(i).to_pylist() for i in range(4))
            for a, b in chunks(texts):
                for j, found in enumerate(tokenizer.encode(texts[a:b]), a):
                    if own[j] != part:
                        if names:
                            yield commit()
                        part, ids, names, counts = own[j], [], [], []
                    ids += [found.astype(tokenizer.dtype), end] * many[j]
                    names += [keys[j]] * many[j]
                    counts += [len(found) + 1] * many[j]
                ids = [np.concatenate(ids)] if ids else ids
        if names:
            yield commit()

    return materialize(dealt.mapInArrow(encode, "file string, part int, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files of a manifest."""
    spark = manifest.sparkSession
    # running sums in two levels: within blocks of files, and over the blocks
    files = manifest.withColumn("block", F.floor(F.col("part") / _FILES_PER_BLOCK))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = files.groupBy("block").agg(F.sum("n_ids").alias("n_ids")).select("block", before(W.orderBy("block")).alias("base"))
    files = files.withColumn("own", before(W.partitionBy("block").orderBy("part"))).join(blocks, "block").select("file", "part", (F.col("base") + F.col("own")).alias("first"))
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "part")

    def decode(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(read_file(name))
                ids = f.ids()
                stops = np.cumsum(f.counts)
                starts = stops - f.counts
                sums = np.array([digest(ids[a:b]) for a, b in zip(starts, stops, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.docs, pa.int64()), pa.array(starts + first), pa.array(f.counts), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "first").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame) -> DataFrame:
    """Write token files to the shared folder and return what reads back from them."""
    return read_token_files(write_token_files(docs, shared_folder(docs.sparkSession, "token-files")))
