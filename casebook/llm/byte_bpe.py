"""Byte-level BPE encoding and decoding with a segment tree of pair ranks (operator 5).

Every match of the split pattern is encoded on its own.  Its byte positions are the leaves
of a segment tree; a leaf holds the rank of the pair that starts there and the position, an
inner node the smaller of its children, so the root is the leftmost minimum-rank pair.  A
merge touches three leaves (the merged symbol, the symbol it swallowed, its live left
neighbour) and walks their paths to the root: O(log n) per merge.  Pre-tokens of similar
length go through their trees side by side in numpy arrays; one of ``LONG_PIECE`` bytes or
more gets a tree of its own.

Plain ASCII is split by array work, other text by the pattern, a distinct pre-token is encoded
once per worker (bounded cache).  Encoding, decoding and ``digests`` (both, and their digests)
are narrow maps without a shuffle.  Null and empty texts have no ids and decode to no bytes;
repeated rows give repeated results; an empty table gives no rows; other columns are not read;
a very long text is a chunk of its own, its memory a small multiple of its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from casebook.llm.common import Memo, batches_of, chunks, doc_texts, ragged
from casebook.llm.pair_table import NO_PAIR, PairTable
from casebook.llm.word_arrays import TextBytes, byte_strings, gather, spaced_words

CACHE_WORDS = 200_000
#: The pattern that ``spaced_words`` follows; with any other, every text is matched as a whole.
PLAIN_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Nodes of the trees that are worked on together (they should fit a core's cache).
TREE_NODES = 1 << 18
#: A pre-token of this many bytes gets a tree of its own: there is nothing to do beside it.
LONG_PIECE = 2048
NONE = np.iinfo(np.int64).max
U = np.uint32


class ByteBpe:
    """Ranks of byte strings; the rank of a string is its token id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        base = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * base
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split, self.plain = regex.compile(pattern).findall, pattern == PLAIN_PATTERN
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=U)
        # every way to make a token from two tokens: (left, right) -> rank of the whole
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(made), base)
        if base * LONG_PIECE > NO_PAIR:
            raise ValueError("rank and position don't fit 31 bits")
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        decimal = [b"%d " % i for i in range(base)]
        self.decimal_bytes = np.frombuffer(b"".join(decimal), dtype=np.uint8)
        self.decimal_size = np.array([len(t) for t in decimal], dtype=np.int64)
        self.decimal_at = np.cumsum(self.decimal_size) - self.decimal_size
        self.known = Memo(CACHE_WORDS)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each byte string, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        get = self.ranks.get
        for i, piece in enumerate(pieces):
            whole = get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            width = max(2, 1 << bits)
            if width >= LONG_PIECE:
                for i in members:
                    out[i] = self._tree(pieces[i], width)
                continue
            step = max(1, TREE_NODES // (2 * width))
            for a in range(0, len(members), step):
                some = members[a:a + step]
                for i, ids in zip(some, self._trees([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _trees(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Flat arrays: the tree of row r at 2 * width * r, its symbols at width * r."""
        n, bits = len(pieces), width.bit_length() - 1
        none = np.int32(NO_PAIR)
        size = np.fromiter(map(len, pieces), dtype=np.int32, count=n)
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8)
        place = np.tile(np.arange(width, dtype=np.int32), n)
        ends = np.repeat(size, width)
        sym = self.byte_id[data]
        alive = place < ends
        after = np.where(place + 1 < ends, place + 1, np.int32(width))    # width: no neighbour
        before = place - 1                                                # -1: no neighbour
        tree = np.full((n, 2 * width), none)
        leaf = np.full(n * width, none)
        at = np.flatnonzero(after < width)
        rank = self.pairs.rank(sym[at], sym[at + 1])
        leaf[at] = np.where(rank != none, (rank << bits) + place[at], none)
        tree[:, width:] = leaf.reshape(n, width)
        step = width
        while step > 1:
            tree[:, step // 2:step] = np.minimum(tree[:, step:2 * step:2], tree[:, step + 1:2 * step:2])
            step //= 2
        tree = tree.ravel()
        row = np.flatnonzero(tree[1::2 * width] != none)
        while len(row):
            own, top = row << bits, row << (bits + 1)
            best = tree[top + 1]
            pos, new = best & (width - 1), (best >> bits).astype(U)
            here = own + pos
            gone = after[here]
            there = own + gone
            nxt, prev = after[there], before[here]
            sym[here], alive[there], after[here] = new, False, nxt
            right = np.flatnonzero(nxt < width)
            left = np.flatnonzero(prev >= 0)
            follows, leads = own[right] + nxt[right], own[left] + prev[left]
            before[follows] = pos[right]
            rank = self.pairs.rank(np.concatenate([new[right], sym[leads]]),
                                   np.concatenate([sym[follows], new[left]]))
            cut = len(right)
            tree[top + width + gone] = none
            value = np.full(len(row), none)
            value[right] = np.where(rank[:cut] != none, (rank[:cut] << bits) + pos[right], none)
            tree[top + width + pos] = value
            tree[top[left] + width + prev[left]] = np.where(
                rank[cut:] != none, (rank[cut:] << bits) + prev[left], none)
            base = np.concatenate([top, top, top[left]])
            node = np.concatenate([gone, pos, prev[left]]) + width
            for _ in range(bits):
                child = base + (node & ~1)
                node >>= 1
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
            row = row[tree[top + 1] != none]
        flat = sym[alive].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(alive.reshape(n, width).sum(axis=1))).tolist()]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _tree(self, piece: bytes, width: int) -> bytes:
        """One long byte string, with the same tree held in a list."""
        n = len(piece)
        sym = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = np.array(sym, dtype=U)
        rank = self.pairs.rank(ids[:-1], ids[1:]).astype(np.int64)
        leaves = np.full(width, NONE, dtype=np.int64)
        leaves[:n - 1] = np.where(rank != NO_PAIR, rank * width + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
        ranks, text = self.ranks.get, self.bytes_of

        def put(pos: int, value: int) -> None:
            node = width + pos
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        def pair(left: int, right: int) -> int:
            r = ranks(text[sym[left]] + text[sym[right]])
            return NONE if r is None else r * width + left

        while tree[1] != NONE:
            new, pos = divmod(tree[1], width)
            gone = after[pos]
            nxt, prev = after[gone], before[pos]
            sym[pos], sym[gone], after[pos] = new, None, nxt
            put(gone, NONE)
            if nxt < n:
                before[nxt] = pos
            put(pos, pair(pos, nxt) if nxt < n else NONE)
            if prev >= 0:
                put(prev, pair(prev, pos))
        return np.array([s for s in sym if s is not None], dtype="<u4").tobytes()


    def learn(self, pieces: list[bytes], closer: set[bytes]) -> None:
        """Make sure that ``known`` holds the ids of the given pieces until the next call; those
        in ``closer`` may hold several matches of the pattern."""
        new = self.known.need(pieces)
        odd = {p: [w.encode("utf-8", "surrogatepass") for w in self.split(p.decode("utf-8", "surrogatepass"))]
               for p in new if p in closer}
        plain = [p for p in new if p not in odd] if odd else new
        own = list(dict.fromkeys(w for words in odd.values() for w in words))
        ids = self.encode_pieces(plain + own)
        self.known.update(zip(plain, ids))
        found = dict(zip(own, ids[len(plain):]))
        for piece, words in odd.items():
            self.known[piece] = b"".join([found[w] for w in words])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's texts, flat, and their number per text."""
        text = TextBytes(column)
        if self.plain:
            pieces, row, whole = spaced_words(text)
        else:
            some = np.flatnonzero(np.diff(text.offsets))
            pieces, row, whole = column.take(pa.array(some)).cast(pa.large_binary()), some, np.ones(len(some), bool)
        if not len(pieces):
            return np.zeros(0, U), np.zeros(len(column), dtype=np.int64)
        coded = pieces.dictionary_encode()
        words, index = byte_strings(coded.dictionary), coded.indices.to_numpy()
        self.learn(words, {words[i] for i in np.unique(index[whole]).tolist()})
        ids = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start, length = np.cumsum(size) - size, size[index]
        sums = np.r_[0, np.cumsum(length)]
        ends = np.searchsorted(row, np.arange(len(column) + 1))
        return gather(np.frombuffer(b"".join(ids), dtype="<u4"), start[index], length), np.diff(sums[ends])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for; ``n`` ids per text."""
        return _texts(self.token_bytes, self.token_at, self.token_size, ids, n)

    def decimal(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Each text's ids as decimal numbers, one space after each."""
        return _texts(self.decimal_bytes, self.decimal_at, self.decimal_size, ids, n)


def _texts(data: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
    length = size[ids]
    raw = gather(data, at[ids], length).tobytes()
    cuts = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(n)]].tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of token ids) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches_of(batches):
            for part in chunks(batch):
                ids, n = bpe.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ragged(ids.astype(np.int32), n, pa.int32())],
                    names=["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ``ids`` and ``decoded`` (the bytes that the ids stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches_of(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                decoded = bpe.decode(ids.flatten().to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ids, pa.array(decoded, pa.binary())],
                    names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by one space) and decoded_sha256
    (of the bytes that the ids decode to): the ids stay in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches_of(batches):
            for part in chunks(batch):
                ids, n = bpe.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n),
                     pa.array([hashlib.sha256(t[:-1]).hexdigest() for t in bpe.decimal(ids, n)], pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, n)], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, "
             "ids_sha256 string, decoded_sha256 string")
