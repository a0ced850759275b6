"""Language ID by unigram piece models whose probabilities are summed over all segmentations.

The pieces are those of a public SentencePiece vocabulary; a language is a
probability for each piece. A word's probability is the sum over all ways to cut
it into pieces (forward algorithm), and a text's is the product over its words,
which are maximal runs of letters, lower-cased, with the vocabulary's word mark
in front. Probabilities are fitted by expectation maximisation on
about ``TRAIN_WORDS`` word types of each language, the most frequent in all its
training documents, a task for each language; a character outside the vocabulary is a piece of its own.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadtrace.llm.kernels import chunks, mix, span_hashes
from roadtrace.llm.storage import small_batches

#: Distinct words of each language that the models are fitted on: the commonest in all training documents.
TRAIN_WORDS = 40_000
ROUNDS = 4
#: Places of a word looked at in one go; the sums of a longer word are carried on, scaled, from part to part.
PART = 24
#: Places after which sums are scaled: no product of so many probabilities, down to 1e-30 each, leaves the doubles.
SCALED = 8
#: Places of all words that are fitted together.
FIT_PLACES = 48_000
CACHE_WORDS = 400_000
#: Rank of the documents that are held out: crc32(doc_id as text) mod FOLDS = HELD_OUT.
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
_MARK = ord("▁")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str) -> list[str]:
    """Lower-case letter pieces of the vocabulary, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    ok = lambda p: p == p.lower() and (p.removeprefix("▁").isalpha() or p == "▁")
    return sorted({p for p in pieces if ok(p)})


_tables: dict = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower case (the first code point of it)."""
    if "letters" not in _tables:
        n = 0x110000
        letter, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
        for c in range(n):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                lower[c] = ord(s.lower()[0])
        _tables["letters"] = letter, lower
    return _tables["letters"]


def letter_words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, starts and ends of letter runs, and the bounds of each text's runs."""
    letter, lower = _letters()
    raw = "\n".join(t or "" for t in texts) + "\n"
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = letter[codes]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum([len(t or "") + 1 for t in texts])
    return lower[codes], starts, ends, np.concatenate([[0], np.searchsorted(starts, stops)])


class Lattice:
    """Pieces at every place of a set of words; runs the forward and backward algorithms for all words and languages at once."""

    def __init__(self, pieces: list[str]):
        codes = [np.array([ord(c) for c in p], np.uint32) for p in pieces]
        flat = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])
        keys = span_hashes(flat, ends - [len(c) for c in codes], ends)
        order = np.argsort(keys)
        self.keys, self.ids, self.n = keys[order], order, len(pieces)
        self.longest = max((len(c) for c in codes), default=1)

    def words(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int = 0, places: int | None = None) -> np.ndarray:
        """Piece ids [word, place, length - 1] (n: not a piece, n + 1: single unknown character) of the marked words' places from ``first`` on, ``places`` of them or all."""
        n = ends - starts + 1 - first
        rest = int(n.max())
        shown = min(rest, places or rest)
        width = min(rest, shown + self.longest - 1)
        place = np.arange(width)
        inside = place[None, :] < n[:, None]
        grid = np.zeros((len(n), width), np.uint32)
        at = starts[:, None] + (first - 1 + place)[None, :]
        grid[inside] = lower[np.maximum(at[inside], 0)]
        if first == 0:
            grid[:, 0] = _MARK
        flat = grid.reshape(-1)
        ids = np.full((len(n), shown, min(self.longest, width)), self.n, np.int32)
        for k in range(1, ids.shape[2] + 1):
            row, column = np.nonzero(place[None, :shown] + k <= n[:, None])
            h = span_hashes(flat, row * width + column, row * width + column + k)
            spot = np.minimum(np.searchsorted(self.keys, h), self.n - 1)
            ids[row, column, k - 1] = np.where(self.keys[spot] == h, self.ids[spot], self.n + 1 if k == 1 else self.n)
        return ids

    def score(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """log probability [word, language] over all segmentations; sums of open words go on from part to part."""
        n, langs = ends - starts + 1, prob.shape[1]
        out, live, first = np.zeros((len(n), langs)), np.arange(len(n)), 0
        carry = np.zeros((len(n), self.longest, langs))
        carry[:, 0] = 1
        while len(live):
            ids = self.words(lower, starts[live], ends[live], first, PART)
            shown, longest = ids.shape[1:]
            alpha, scale = np.zeros((len(live), shown + self.longest, langs)), np.zeros((len(live), shown + 1, langs))
            alpha[:, : self.longest] = carry
            for i in range(shown):
                if i and i % SCALED == 0:
                    top = alpha[:, i : i + self.longest].max(axis=1)
                    top = np.where(top > 0, top, 1)
                    alpha[:, i : i + self.longest] /= top[:, None]
                    scale[:, i:] += np.log(top)[:, None]
                alpha[:, i + 1 : i + 1 + longest] += alpha[:, i : i + 1] * prob[ids[:, i]]
            left = n[live] - first
            done, on = np.flatnonzero(left <= shown), np.flatnonzero(left > shown)
            out[live[done]] += np.log(np.maximum(alpha[done, left[done]], 1e-300)) + scale[done, left[done]]
            carry = alpha[on, shown:]
            top = np.maximum(carry.max(axis=1, initial=0), 1e-300)
            out[live[on]] += np.log(top) + scale[on, shown]
            carry, live, first = carry / top[:, None], live[on], first + shown
        return out

    def expected(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts [piece] of weighted words for one language (prob: one column)."""
        ids, n, p = self.words(lower, starts, ends), ends - starts + 1, prob[:, 0]
        m, width, longest = ids.shape
        rows = np.arange(m)
        # sums are scaled at every SCALED-th place; ``scale`` has the logarithm for each place, ``late`` that of the sums from the end
        alpha, scale = np.zeros((m, width + longest)), np.zeros((m, width + 1))
        alpha[:, 0] = 1
        for i in range(width):
            if i and i % SCALED == 0:
                top = alpha[:, i : i + longest].max(axis=1)
                top = np.where(top > 0, top, 1)
                alpha[:, i : i + longest] /= top[:, None]
                scale[:, i:] += np.log(top)[:, None]
            alpha[:, i + 1 : i + 1 + longest] += alpha[:, i : i + 1] * p[ids[:, i]]
        total = np.log(np.maximum(alpha[rows, n], 1e-300)) + scale[rows, n]
        beta, late = np.zeros((m, width + longest)), np.zeros(m)
        beta[rows, n] = 1
        posterior = np.zeros(ids.shape)
        for i in range(width - 1, -1, -1):
            if (i + 1) % SCALED == 0:
                top = beta[:, i + 1 : i + 1 + longest].max(axis=1)
                top = np.where(top > 0, top, 1)
                beta[:, i + 1 : i + 1 + longest] /= top[:, None]
                late += np.log(top)
            ways = p[ids[:, i]] * beta[:, i + 1 : i + 1 + longest]
            beta[:, i] += ways.sum(axis=1)
            open_ = i < n
            posterior[open_, i] = ways[open_] * (alpha[open_, i] * np.exp(np.minimum(scale[open_, i] + late[open_] - total[open_], 700)) * weight[open_])[:, None]
        return np.bincount(ids.reshape(-1), posterior.reshape(-1), len(p))


def like_lengths(n: np.ndarray, most: int, places: int):
    """Indices of words in groups of like length, at most ``most`` words and about ``places`` places (one word at least)."""
    order, a = np.argsort(n, kind="stable"), 0
    while a < len(order):
        b = min(a + most, len(order))
        while b - a > 1 and (b - a) * int(n[order[b - 1]]) > places:
            b = a + max(1, min((b - a) // 2, places // int(n[order[b - 1]]) or 1))
        yield order[a:b]
        a = b


def fit_language(words: pd.DataFrame, lattice: Lattice) -> np.ndarray:
    """Probabilities of the pieces, of none (0) and of an unknown character, from a frame (word, n) of one language."""
    n_pieces = lattice.n
    p = np.full((n_pieces + 2, 1), 1.0 / (n_pieces + 2))
    p[n_pieces] = 0
    if not len(words):
        return p[:, 0]
    codes = np.array([ord(c) for c in "".join(words["word"])], np.uint32)
    ends = np.cumsum(words["word"].str.len().to_numpy())
    starts = ends - words["word"].str.len().to_numpy()
    weight = words["n"].to_numpy(float)
    groups = list(like_lengths(ends - starts + 1, 5000, FIT_PLACES))
    for _ in range(ROUNDS):
        counts = np.zeros(n_pieces + 2)
        for g in groups:
            counts += lattice.expected(codes, starts[g], ends[g], p, weight[g])
        counts[:n_pieces] += 0.01
        counts[n_pieces + 1] = max(counts[n_pieces + 1], 0.01)
        counts[n_pieces] = 0
        p = (counts / counts.sum())[:, None]
    return p[:, 0]


def _model(pieces: list[str], tables: dict[str, np.ndarray], priors: dict[str, float]) -> dict:
    langs = sorted(priors)
    none = fit_language(pd.DataFrame({"word": [], "n": []}), Lattice(pieces)) if set(langs) - set(tables) else None
    prob = np.stack([tables.get(k, none) for k in langs], axis=1) if langs else np.zeros((len(pieces) + 2, 0))
    return {"langs": langs, "pieces": pieces, "prob": prob, "prior": np.log(np.array([max(priors[k], 1e-9) for k in langs]))}


def fit(words: pd.DataFrame, priors: dict[str, float], path: str | None = None) -> dict:
    """Models from a frame (lang, word, n): languages and a probability table [piece, language]."""
    pieces = _pieces(path or vocabulary_path())
    lattice = Lattice(pieces)
    return _model(pieces, {k: fit_language(words[words["lang"] == k], lattice) for k in priors}, priors)


class Scorer:
    """Scores texts; remembers the log probabilities of words it has seen."""

    def __init__(self, model: dict):
        self.model, self.lattice = model, Lattice(model["pieces"])
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model["langs"])), np.float32)

    def log_probs(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities [text, language] and the number of words of each text."""
        lower, starts, ends, bounds = letter_words(texts)
        if not len(starts):
            return np.zeros((len(texts), len(self.model["langs"]))), np.diff(bounds)
        hashes = span_hashes(lower, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.keys, self.values = self.keys[:0], self.values[:0]
        spot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort((ends - starts)[first[new]], kind="stable")]  # words of like length share a grid
            parts = []
            for a in range(0, len(new), 4000):
                at = first[new[a : a + 4000]]
                parts.append(self.lattice.score(lower, starts[at], ends[at], self.model["prob"]).astype(np.float32))
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, *parts])[order]
            spot = np.searchsorted(self.keys, unique)
        each = self.values[spot][inverse].astype(np.float64)
        sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
        return sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds)


_scorers: dict[str, Scorer] = {}


def held_out(doc_id):
    """crc32 of the id as text, mod FOLDS, is HELD_OUT; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, train_words: int = TRAIN_WORDS, path: str | None = None) -> dict:
    """Models of the languages of ``docs`` (rows of a null lang or text teach nothing).

    Words are counted over all rows; of each language the ``train_words`` commonest
    types (about; of the rarest count taken a share by hash) come to the fit, which bounds it whatever the corpus.
    """
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("lang", "text")

    def count(batches):
        import collections

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            sums: collections.Counter = collections.Counter()
            for a, b in chunks(texts):
                lower, starts, ends, bounds = letter_words(texts[a:b])
                if not len(starts):
                    continue
                lang = np.array([zlib.crc32(x.encode()) for x in langs[a:b]], np.uint64)
                h = span_hashes(lower, starts, ends) ^ mix(np.repeat(lang, np.diff(bounds)))
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                doc = np.searchsorted(bounds[1:], first, side="right")
                text = lower.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist(), strict=True):
                    sums[langs[a + d], text[starts[f] : ends[f]]] += m
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    counts = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # words of like count are one class; whole classes are taken from the commonest on, of the last one a share by hash
    classes = counts.groupBy("lang", "n").agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.partitionBy("lang").orderBy(F.desc("n"))) - F.col("m")
    classes = classes.withColumn("before", before).where(F.col("before") < train_words)  # at most train_words of each language
    share = classes.select("lang", "n", F.least(F.lit(1.0), (train_words - F.col("before")) / F.col("m")).alias("share"))
    best = counts.join(F.broadcast(share), ["lang", "n"]).where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(langs.values())
    path = path or vocabulary_path()

    def fit_one(frame: pd.DataFrame) -> pd.DataFrame:
        p = fit_language(frame.sort_values(["n", "word"]), Lattice(_pieces(path)))
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "p": [p.tolist()]})

    # a task for each language, of some train_words rows; the tables (one number for each piece) come to the driver
    tables = best.select("lang", "word", "n").groupBy("lang").applyInPandas(fit_one, "lang string, p array<double>")
    return _model(_pieces(path), {r["lang"]: np.array(r["p"]) for r in tables.toLocalIterator()}, {k: n / total for k, n in langs.items()})


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` in ``doc`` (struct), lang_pred and score (0 to 1).

    The score is the posterior of the predicted language with each text's evidence
    scaled to at most 20 words, so that long texts keep graded scores. A text that
    is null or has no letter, or any text where no language was learned, is ``und`` with score 0.
    """
    small_batches(docs.sparkSession)
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        model = shared.value
        if tag not in _scorers:
            _scorers.clear()
            _scorers[tag] = Scorer(model)
        scorer = _scorers[tag]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [], []
            for a, b in chunks(texts):
                if not model["langs"]:
                    names += [UNDETERMINED] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                logs, n = scorer.log_probs(texts[a:b])
                best = np.argmax(logs + model["prior"], axis=1)
                scaled = logs * np.minimum(1, 20 / np.maximum(n, 1))[:, None] + model["prior"]
                scaled -= scaled.max(axis=1, keepdims=True)
                p = np.exp(scaled)
                p = p[np.arange(len(n)), best] / p.sum(axis=1)
                names += [model["langs"][i] if m else UNDETERMINED for i, m in zip(best, n, strict=True)]
                scores += [float(x) if m else 0.0 for x, m in zip(p, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc", "lang_pred", "score"])

    rows = docs.select("text", F.struct("*").alias("doc"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learn from the rows that are not held out and predict all: ``predict``'s columns and held_out."""
    model = train(docs.where(~held_out(F.col("doc_id"))), path=path)
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc.doc_id")))
