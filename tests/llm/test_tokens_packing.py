"""Token files round trip, tokenizer equality, and packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadtrace.llm import packing, rans
from roadtrace.llm.storage import shared_folder
from roadtrace.llm.tokens import WordCachedTokenizer, tokenizer_path

TEXTS = ["", None, "It's 'twas DON'T", "é é\x85\xa0x", "中文 and Ω", "<|endoftext|> a", "a" * 5000, "one two " * 3000, "x\ny", "x\ny"]
SCHEMA = "lang string, doc_id long, text string, _id int, _text string"


def table(spark, rows):
    return spark.createDataFrame([("en", i, t, 7, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return WordCachedTokenizer(tokenizer_path(), cache_words=50)


def whole(tokenizer, text):
    return tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉßs'trevlmd \n\t\x85\xa0\x1c09²½ª_-.,!中İΣς́é<|>", max_size=20), max_size=8))
def test_ids_are_the_librarys(texts):
    t = _shared()
    assert [x.tolist() for x in t.encode(texts)] == [whole(t, x) for x in texts]


_held = []


def _shared():
    if not _held:
        _held.append(WordCachedTokenizer(tokenizer_path(), cache_words=50))
    return _held[0]


@pytest.mark.parametrize("n,vocab", [(0, 1), (1, 5), (63, 40_000), (65_536, 3), (200_001, 49_408)])
def test_file_round_trip_and_blocks(n, vocab):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % vocab).astype(np.uint16)
    f = rans.TokenFile(rans.encode_file(ids, [None, 5, 2**40], np.array([0, 1, max(0, n - 1)])))
    assert (f.ids() == ids).all() and f.docs == [None, 5, 2**40]
    for b in range(f.header["n_blocks"]):  # each from its own checkpoint
        assert (f.ids(b, 1) == ids[b * rans.BLOCK : (b + 1) * rans.BLOCK]).all()


def test_damage_is_noticed():
    data = bytearray(rans.encode_file(np.arange(5000, dtype=np.uint16), [1], np.array([5000])))
    data[-200] ^= 1
    with pytest.raises(ValueError):
        rans.TokenFile(bytes(data)).ids()


def test_token_files(spark, tokenizer):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again")]
    df = table(spark, rows)
    got = {(r["start"]): r for r in rans.token_binary(df.repartition(3)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for i, t in order:
        ids = whole(tokenizer, t) + [1]
        assert (got[at]["doc_id"], got[at]["n_tokens"]) == (i, len(ids))
        assert got[at]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert rans.token_binary(df.limit(0)).count() == 0
    again = rans.write_token_files(df, shared_folder(spark, "t")).agg({"n_ids": "sum"}).head()[0]
    assert again == at


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(by)


def test_pack(spark, tokenizer):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, None)]
    got = packing.pack(table(spark, rows)).collect()
    check_packed(got, packing.CAPACITY)
    pieces = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = []
    for i, t in rows:
        ids = whole(tokenizer, t) + [1]
        want += [(i if i is not None else -1, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)]
    assert pieces == sorted(want)
    assert packing.pack(table(spark, rows).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_piece_once(counts):
    rows = packing.plan(counts, 60)
    seen, bins = {}, {}
    for length, first, n, sequence, offset in rows:
        for r in range(n):
            assert (length, first + r) not in seen
            seen[length, first + r] = True
            bins.setdefault(sequence + r, []).append((offset, length))
    assert len(seen) == sum(counts.values()) and all((k, r) in seen for k, c in counts.items() for r in range(c))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 60
    # no two sequences would fit into one, and there are no more than best-fit decreasing's 11/9 of the optimum,
    # which is at most 3/2 of the bound by the pieces that cannot share a sequence
    fill = sorted(sum(n for _, n in parts) for parts in bins.values())
    assert len(fill) < 2 or fill[0] + fill[1] > 60
    assert len(bins) <= 11 / 9 * 3 / 2 * least_sequences(counts, 60) + 4


def least_sequences(counts, capacity):
    """Lower bound: for each k the pieces above capacity - k stand without any of k or more, those above half of it without each other."""
    best = 0
    for k in [0, *(x for x in counts if 2 * x <= capacity)]:
        alone = sum(c for x, c in counts.items() if x > capacity - k)
        half = {x: c for x, c in counts.items() if capacity - k >= x > capacity / 2}
        rest = sum(x * c for x, c in counts.items() if k <= x <= capacity / 2) - sum((capacity - x) * c for x, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-rest // capacity)))
    return best


def test_least_sequences():
    assert least_sequences({25: 14, 26: 5, 36: 15}, 60) == 23 and least_sequences({30: 4}, 60) == 2 and least_sequences({}, 60) == 0
