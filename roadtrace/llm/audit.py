"""What each of five text filters removes in every order of them: counts in a 2 x 2 x 2 x 2 x 2 table for each part, contracted along its axes.

Documents are reduced to which filters they fail; a part's counts (all documents,
good ones, toxic ones) by the 32 patterns are all that the audit needs. For a step of an
order a vector stands on each axis: (1, 0) keeps those that pass, (0, 1) those that
fail, (1, 1) both; the contraction of table and vectors is the count.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.storage import join_hot, materialize, small_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Bytes of a text from which its words are taken one by one instead of in a list.
LONG_TEXT = 1 << 23
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
PASS, FAIL, ALL = np.array([[1, 0], [0, 1], [1, 1]])


def text_fails(text: bytes) -> int:
    """Which of A to D a text (UTF-8) fails, as the number with bits A = 16, B = 8, C = 4, D = 2."""
    if len(text) < LONG_TEXT:
        words = text.split()  # ASCII blanks: space and 9 to 13
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in _WORD.finditer(text):
            seen.add(m.group())
            n += 1
        distinct = len(seen)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return 16 * (n < MIN_WORDS) + 8 * (100 * distinct < LEAST_DISTINCT * n) + 4 * (100 * capitals > MOST_CAPITALS * points) + 2 * (_SIGNS.search(text) is not None)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text), fails (A to D) of each row."""
    small_batches(docs.sparkSession)

    def judge(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            digests = [hashlib.sha256(t).digest()[:16] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array([text_fails(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "fails"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, part string, digest binary, fails int")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (A to E), n, good, toxic: documents by part and the filters they fail.

    Copies are told by the text's digest. A document's label is looked up by its id;
    one text, one id or one part may hold any share of the rows: rows are added up
    before they meet, and what stays of frequent keys is broadcast.
    """
    rows = materialize(judged(docs), "judged")
    total = rows.count()
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias("good" if c == "quality" else c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic")).where("good + toxic > 0")
    times = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    marks = materialize(marks.join(times, "doc_id", "left").select("doc_id", "good", "toxic", F.coalesce("times", F.lit(1)).alias("times")), "marks")
    rows = join_hot(rows, marks, "doc_id", "times", total, ["good", "toxic"]).fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "fails", "good", "toxic"]
    rows = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("c"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    rows = rows.groupBy(*kind).agg(F.sum("c").alias("c"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"))
    rows = materialize(rows, "kinds")
    least = materialize(rows.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("m")), "least")
    rows = join_hot(rows, least, "digest", "m", rows.count(), ["least"])
    unique = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("fails"), unique.alias("n")), F.struct((F.col("fails") + 1).alias("fails"), (F.col("c") - unique).alias("n"))))
    rows = rows.select("part", "good", "toxic", both.alias("x")).where("x.n > 0")
    return rows.groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def contract(tables: np.ndarray, on: dict[str, np.ndarray]) -> np.ndarray:
    """Counts of ``tables`` (any leading axes, then one of length 2 for each filter) with a vector on each filter's axis (``ALL`` where none is given)."""
    axes = FILTERS.lower()
    return np.einsum(f"...{axes},{','.join(axes)}->...", tables, *(on.get(f, ALL) for f in FILTERS))


def audit_tables(tables: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each order and step of it the audit's counts; ``tables`` is parts x (all, good, toxic) x 2 x 2 x 2 x 2 x 2, each count has a value for each part."""
    own = {f: contract(tables[:, 0], {f: FAIL}) for f in FILTERS}
    unique = {f: contract(tables[:, 0], {g: FAIL if g == f else PASS for g in FILTERS}) for f in FILTERS}
    out = []
    for order in ORDERS:
        for step, f in enumerate(order):
            passed = {g: PASS for g in order[:step]}
            removed = contract(tables, passed | {f: FAIL})
            kept = contract(tables[:, 0], passed | {f: PASS})
            out.append({"filter_order": order, "step": step + 1, "kept": kept, "removed": removed[:, 0], "redundant": own[f] - removed[:, 0], "unique_fails": unique[f], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2]})
    shapley = {f: reduce(np.add, (r["removed"] for r in out if r["filter_order"][r["step"] - 1] == f)) for f in FILTERS}
    for r in out:
        r["shapley"] = shapley[r["filter_order"][r["step"] - 1]]
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts: 600 rows for each part (600 = orders x steps), zeros included.

    A: under 200 words; B: fewer than 50 distinct words of 100; C: more than 2 capitals
    (A-Z) of 100 code points; D: holds one of ``#$%&*|``; E: the text is that of a row
    with a smaller doc_id. A null text is empty, a null source the empty part. A null
    doc_id has no label, is smaller than none and never fails E for another; rows
    that repeat an id do not fail E for each other. A document of several labels is good
    (toxic) if one of them says so. An empty table gives no rows.
    """
    rows = patterns(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))  # at most 32 cells

    def audit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for start in range(0, batch.num_rows, 100):
                some = batch.slice(start, 100)
                tables = np.zeros((some.num_rows, 3, 2 ** len(FILTERS)), np.int64)
                for i, cells in enumerate(some.column(1).to_pylist()):
                    for cell in cells:
                        tables[i, :, cell["fails"]] = cell["n"], cell["good"], cell["toxic"]
                found = audit_tables(tables.reshape(-1, 3, *[2] * len(FILTERS)))
                names = some.column(0).to_pylist()
                columns = [pa.array(names * len(found)), pa.array([r["filter_order"] for r in found for _ in names]), pa.array([r["step"] for r in found for _ in names], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate([r[c] for r in found])) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def _oracle() -> str:
    removed = "len([x FOR x IN before IF fails[x]]) = 0"
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS copy FROM documents
), judged AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, copy AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM docs LEFT JOIN labels USING (doc_id)
), cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), orders AS (
  SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT array_to_string([substr('ABCDE', CAST(x AS INTEGER), 1) FOR x IN o], '') AS filter_order, step, o[step] AS f, list_slice(o, 1, step - 1) AS before FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
), counted AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER ({removed} AND NOT fails[f]) AS kept, sum(n) FILTER ({removed} AND fails[f]) AS removed, sum(n) FILTER (NOT ({removed}) AND fails[f]) AS redundant,
         sum(n) FILTER (fails[f] AND len([x FOR x IN fails IF x]) = 1) AS unique_fails, sum(good) FILTER ({removed} AND fails[f]) AS good_lost, sum(toxic) FILTER ({removed} AND fails[f]) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in COUNTS[:-1])},
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""


#: The rows of ``filter_audit`` where doc_id is unique and never null.
ORACLE = _oracle()
