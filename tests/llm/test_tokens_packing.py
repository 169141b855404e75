"""Token counts, byte-level BPE and packing against the public tokenizer libraries."""
import base64
import hashlib
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.llm import byte_bpe, packing, token_counts
from casebook.llm.catalog import BYTE_RANKS, WORD_BPE
from casebook.llm.common import Memo, stage
from casebook.llm.pair_table import NO_PAIR, PairTable
from casebook.llm.word_arrays import gather
from .helpers import awkward_texts, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def tik():
    with open(BYTE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(spark, library):
    texts = awkward_texts()
    out = token_counts.count_tokens(documents(spark, texts), WORD_BPE, limit=100)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 100), t


def test_counts_of_null_ids_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", "a b", "c"], ids=[7, 7, None])
    assert sorted((r.doc_id is None, r.n_tokens) for r in
                  token_counts.count_tokens(docs, WORD_BPE).collect()) == [(False, 2), (False, 2), (True, 1)]
    assert token_counts.count_tokens(docs.limit(0), WORD_BPE).count() == 0


def own_ids(texts):
    flat, at, size, n = token_counts.word_bpe(WORD_BPE).encode(pa.array(texts, pa.string()))
    ids, ends = gather(flat, at, size).tolist(), np.cumsum(n).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


ODD = st.text(alphabet=st.sampled_from(list("aAbBthe' \n\t!0９éßΣσİ漢😀́ <|>\x1c\x85\u2003")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_rounds_follow_rank_order(texts):
    library = _LIB.setdefault("t", Tokenizer.from_file(WORD_BPE))
    assert own_ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_is_split_and_lowered_as_by_the_library(library):
    """All code points that either Unicode table knows (but surrogates and private use), among
    letters, marks and themselves."""
    newer = set(token_counts.newer_characters(r"[\p{L}\p{N}\p{M}\p{P}\p{S}\p{Z}]"))
    known = [c for c in map(chr, range(sys.maxunicode + 1))
             if c in newer or unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    assert len(known) > 150_000
    for at in range(0, len(known), 20_000):
        texts = [f"a{c}b !{c}{c}" for c in known[at:at + 20_000]]
        want = library.encode_batch(texts, add_special_tokens=False)
        wrong = [t for t, e, own in zip(texts, want, own_ids(texts)) if e.ids != own]
        assert not wrong, wrong[:20]


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_bytes_follow_the_pattern(texts):
    if "k" not in _LIB:
        with open(BYTE_RANKS, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LIB["k"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.byte_bpe(BYTE_RANKS, P.PATTERN)
    assert bpe.plain
    ids, n = bpe.encode(pa.array(texts, pa.string()))
    want = [_LIB["k"].encode_ordinary(t) for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert bpe.decode(ids, n) == [t.encode() for t in texts]


def test_another_pattern_is_matched_as_it_is():
    pattern = r"\p{L}+|\s|[^\p{L}\s]"
    bpe = byte_bpe.ByteBpe(BYTE_RANKS, pattern)
    texts = ["the cat  sat,", "", "é1 2\n"]
    ids, n = bpe.encode(pa.array(texts))
    assert bpe.decode(ids, n) == [t.encode() for t in texts] and n.tolist()[0] >= 7


def test_digests_are_those_of_the_separate_steps(spark, tik):
    texts = awkward_texts()
    out = {r.doc_id: r for r in byte_bpe.digests(documents(spark, texts), BYTE_RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = tik.encode_ordinary(t or "")
        assert (out[i].n_tokens, out[i].ids_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_pair_table_equals_a_dictionary():
    rng = np.random.default_rng(4)
    keys = rng.choice(500 * 500, 9000, replace=False)
    table = PairTable(keys // 500, keys % 500, np.arange(9000), 500)
    want = dict(zip(keys.tolist(), range(9000)))
    every = np.arange(250_000)
    got = table.rank((every // 500).astype(np.uint32), (every % 500).astype(np.uint32))
    assert got.tolist() == [want.get(k, NO_PAIR) for k in every.tolist()]


def test_words_in_use_outlast_a_full_cache():
    memo = Memo(10)
    for i in range(100):
        batch = {"often", f"w{i}", f"v{i}"}
        new = memo.need(batch)
        assert ("often" in new) == (i == 0)
        memo.update((w, w.upper()) for w in new)
        assert all(memo[w] == w.upper() for w in batch)
        assert len(memo) + len(memo.old) <= 2 * 10 + 3


_LIB: dict = {}


def test_encode_decode_equal_the_library(spark, tik):
    texts = awkward_texts()
    both = byte_bpe.decode(byte_bpe.encode(documents(spark, texts), BYTE_RANKS, P.PATTERN),
                           BYTE_RANKS, P.PATTERN)
    rows = {r.doc_id: r for r in both.collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == tik.encode_ordinary(t or ""), t
        assert bytes(rows[i].decoded) == (t or "").encode()
    digest = both.where("doc_id = 8").select(F.sha2(F.array_join("ids", " "), 256)).first()[0]
    want = " ".join(map(str, tik.encode_ordinary(texts[8])))
    assert digest == hashlib.sha256(want.encode()).hexdigest()
    assert byte_bpe.encode(documents(spark, texts).limit(0), BYTE_RANKS, P.PATTERN).count() == 0


def test_segment_tree_takes_the_leftmost_of_equal_ranks(tik):
    bpe = byte_bpe.byte_bpe(BYTE_RANKS, P.PATTERN)
    for word in (b"aaaaaaa", b"ababababab" * 9, "éé漢漢".encode() * 20, b"\xff\xfe\xff", b"a"):
        ids = np.frombuffer(bpe.encode_pieces([word])[0], "<u4").tolist()
        assert b"".join(bpe.bytes_of[i] for i in ids) == word
        try:
            assert ids == tik.encode_ordinary(word.decode())
        except UnicodeDecodeError:
            pass


def test_pieces_and_places(spark, library):
    texts = awkward_texts()
    cap = 64
    cut = packing.pieces(documents(spark, texts), WORD_BPE, capacity=cap)
    items = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    rows = packing.pack(items, capacity=cap, bucket_pieces=100).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), cap)):
            own = ids[a:a + cap]
            want[i, k] = (a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.crc) for r in rows} == want
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    assert packing.pack(items.limit(0), capacity=cap).count() == 0


def test_rows_with_one_id_spread_over_the_buckets(spark):
    items = stage(spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"),
                                          F.lit(7).cast("long").alias("length")))
    rows = packing.pack(items, capacity=20, bucket_pieces=50).collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 8 and len(rows) == 400
    assert len({(r.sequence_id, r.offset) for r in rows}) == 400


def test_packing_is_tight_and_repeats_stay():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 3000)
    seq, offset = packing.place(lengths, 1000)
    assert seq.max() + 1 <= -(-lengths.sum() // 1000) * 1.005 + 1
    seq, _ = packing.place(np.array([500, 500, 500]), 1000)
    assert sorted(seq.tolist()) == [0, 0, 1]
