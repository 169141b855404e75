"""Token counts by rank-synchronous array merging (operator 1).

The pre-tokens of a batch are held as one flat numpy array of symbols with the ends of the
sequences marked (a ragged array).  In every round each sequence finds its lowest-rank
adjacent pair and merges *all* places of that pair at once; sequences without a mergeable
pair retire.  The surviving symbols are the tokens.

White space always ends a pre-token, so a chunk of texts is first cut at ASCII blanks, runs of
plain ASCII also into their words, and the distinct pieces are taken (array work, no Python
object per word).  A run of other characters is cut at the special strings (each one
token, as the tokenizer's default has it), normalised (NFC, per-character lower case) and split
by the tokenizer's pattern.  A distinct piece is worked out once per worker and remembered in
a bounded cache.  One narrow map, no shuffle.

Null and empty texts have 0 tokens; repeated rows give repeated results; an empty table
gives an empty result; the tables' other columns are not read; a very long text is a chunk of
its own, its memory a small multiple of its length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from casebook.llm.common import Memo, batches_of, chunks, doc_texts
from casebook.llm.pair_table import NO_PAIR, PairTable
from casebook.llm.word_arrays import TextBytes, byte_strings, gather, plain_words

#: Pieces remembered by one Python worker (per generation of the cache).
CACHE_WORDS = 200_000
U = np.uint32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others take code points from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def newer_characters(kind: str) -> list[str]:
    """Characters that ``regex`` counts to a class and this Python's Unicode tables don't know yet."""
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return regex.findall(kind, unknown)


def _parts(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word mark, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in byte_symbols()], dtype=U)
        self.last = np.array([vocab[c + end] for c in byte_symbols()], dtype=U)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in column], dtype=U)
                             for column in zip(*[(a, b, a + b) for a, b in merges]))
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make one symbol: rounds would not follow rank order")
        self.made = made
        self.pairs = PairTable(left, right, np.arange(len(made)), max(vocab.values()) + 1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                     if p["type"] == "Split")
        self._classes(split, Tokenizer.from_file(path))
        self.odd_re = re.compile(rb"[^\x21-\x7e]|'|<\|")
        self.known = Memo(CACHE_WORDS)

    def _classes(self, split: str, library: Tokenizer) -> None:
        """The split pattern with the library's own classes and lower case for the characters
        that are newer than Python's tables."""
        other: dict[str, list[str]] = {"L": [], "N": []}
        self.lower: dict[int, str] = {}
        cut = library.pre_tokenizer.pre_tokenize_str
        for c in newer_characters(r"[\p{L}\p{N}]"):
            kind = "L" if regex.match(r"\p{L}", c) else "N"
            is_letter = len(cut("a" + c)) == 1
            is_other = len(cut("!" + c)) == 1
            if (kind == "L") != is_letter or (kind == "N" and is_other):
                other[kind].append(c)
            low = library.normalizer.normalize_str(c)
            if low != c.lower():
                self.lower[ord(c)] = low
        split += r"|\n"
        self.words_re = regex.compile(split)
        for kind, characters in other.items():
            if characters:
                split = split.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{''.join(characters)}]]")
        self.newer, self.newer_re = {*other["L"], *other["N"]}, regex.compile(split, regex.VERSION1)
        self.lower_re = regex.compile(f"[{''.join(map(chr, self.lower))}]") if self.lower else None

    def normal(self, text: str) -> str:
        """NFC and per-character lower case."""
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.lower_re is not None and self.lower_re.search(low):
            low = low.translate(self.lower)
        return low

    def words(self, low: str) -> list[str]:
        """Words of a normalised text; line feeds come as they are."""
        plain = low.isascii() or self.newer.isdisjoint(low)
        return (self.words_re if plain else self.newer_re).findall(low)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words (UTF-8), flat, and the number of ids of each word."""
        span = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        count, which = np.zeros(len(words), dtype=np.int64), np.flatnonzero(span)
        span = span[which]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.zeros(len(data), dtype=bool)
        last[np.cumsum(span) - 1] = True
        sym = np.where(last, self.last[data], self.inner[data])
        rank = np.full(len(sym), NO_PAIR, dtype=np.int32)
        at = np.flatnonzero(~last)
        rank[at] = self.pairs.rank(sym[at], sym[at + 1])
        done, done_which, done_span = [], [], []
        while len(sym):
            first = np.cumsum(span) - span
            best = np.minimum.reduceat(rank, first)
            live = best != NO_PAIR
            if not live.all():
                done.append(sym[np.repeat(~live, span)])
                done_which.append(which[~live])
                done_span.append(span[~live])
                keep = np.repeat(live, span)
                sym, rank, last = sym[keep], rank[keep], last[keep]
                which, span, best = which[live], span[live], best[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, span)
            if (hit[1:] & hit[:-1]).any():
                # in a run of overlapping hits (one symbol repeated) every second one merges
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
                hit &= (place - run) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(span)), span)[at]
            span = span - np.bincount(owner, minlength=len(span))
            sym, rank, last = sym[keep], rank[keep], last[keep]
            # only pairs beside a merged symbol are new
            at = at - np.arange(len(at))
            left = at[at > 0] - 1
            changed = np.concatenate([at, left[~last[left]]])
            rank[changed] = NO_PAIR
            changed = changed[~last[changed]]
            rank[changed] = self.pairs.rank(sym[changed], sym[changed + 1])
        flat = np.concatenate([np.zeros(0, U), *done])
        which = np.concatenate([np.zeros(0, np.int64), *done_which])
        span = np.concatenate([np.zeros(0, np.int64), *done_span])
        start = np.zeros(len(words), dtype=np.int64)
        start[which], count[which] = np.cumsum(span) - span, span
        return gather(flat, start, count), count

    def learn(self, pieces: list[bytes]) -> None:
        """Make sure that ``known`` holds the ids (little-endian 32-bit) of the given pieces (as
        ``plain_words`` cuts them), until the next call."""
        new = self.known.need(pieces)
        if not new:
            return
        odd = [p for p in new if not p.isalnum() and self.odd_re.search(p)]
        if odd:
            left_out = set(odd)
            new = [p for p in new if p not in left_out]
        flat, n = self.merge(new)
        self.known.update(zip(new, _parts(flat, n)))
        marked = [p for p in odd if b"<|" in p]
        if len(marked) < len(odd):
            left_out = set(marked)
            odd = [p for p in odd if p not in left_out]
            self.known.update(zip(odd, self.lines("\n".join([p.decode("utf-8", "surrogatepass") for p in odd]))))
        for piece in marked:       # special strings are cut out before anything is normalised
            cut = self.special_re.split(piece.decode("utf-8", "surrogatepass"))
            self.known[piece] = b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self.lines(p)[0]
                                         for i, p in enumerate(cut))

    def lines(self, text: str) -> list[bytes]:
        """Ids (little-endian 32-bit) of each line of a text."""
        words = self.words(self.normal(text))
        own = list(dict.fromkeys(words))
        flat, n = self.merge([w.encode("utf-8", "surrogatepass") for w in own])
        ids = dict(zip(own, _parts(flat, n)))
        ids["\n"] = b""
        found, ends = list(map(ids.__getitem__, words)), [i for i, w in enumerate(words) if w == "\n"]
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], [*ends, len(words)])]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts of a column as pieces: (ids of the distinct pieces, flat; each piece's place in
        it; its length; the number of ids of each text).  Ids follow with ``gather``."""
        words, row = plain_words(TextBytes(column))
        if not len(words):
            none = np.zeros(0, dtype=np.int64)
            return none.astype(U), none, none, np.zeros(len(column), dtype=np.int64)
        coded = words.dictionary_encode()
        pieces, index = byte_strings(coded.dictionary), coded.indices.to_numpy()
        self.learn(pieces)
        ids = list(map(self.known.__getitem__, pieces))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(size) - size
        length = size[index]
        sums = np.r_[0, np.cumsum(length)]
        ends = np.searchsorted(row, np.arange(len(column) + 1))
        return np.frombuffer(b"".join(ids), dtype="<u4"), start[index], length, np.diff(sums[ends])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches_of(batches):
            for part in chunks(batch):
                text = part.column("text")
                n = bpe.encode(text)[3]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(TextBytes(text).offsets)),
                     pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_texts(docs).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
             "n_bytes long, n_tokens long, over_limit boolean")
