"""MinHash near-dedup by one-permutation hashing and star-shaped candidates (operator 12).

A text's set holds its distinct word shingles (64-bit hashes).  One permutation: a hash is
dealt to one of ``BINS`` bins by its upper half, and a bin keeps its least value.  An empty
bin is filled by optimal densification: it probes bins in an order given by a universal hash
of (bin, attempt) until it meets a filled one, so two sets agree in it with the
probability of their similarity.  ``ROWS`` bins together are a band, equal bands a bucket.

Equal sets meet first (one row per set from here on).  A bucket emits a star, not its pairs:
its centre is the member with the most bucket mates over all bands, and each other member
gets one candidate edge to it.  Edges are confirmed on the full sets, the confirmed ones give
components.

A star alone can miss a link between two members that don't both link to the centre.  Those are
found exactly, from the differences to the centre: with D(x) = x minus centre plus centre
minus x, the overlap of D(x) and D(y) decides whether x and y link.  A member that did not get into
its centre's component needs only be compared with members that share an element of a
*prefix* of its differences (rarest first; its length follows from the overlap that any
link must have at least), so near copies of one text, whose differences are their own, meet
hardly any partner.  See ``_beside_the_centre``.

What may be lost: a pair of sets that share no bucket (at similarity 0.85: (1 - 0.85^5)^28,
below 1e-7), and errors of the 64-bit shingle hashes (a chance of about 1e-13 for a pair of
1 000-shingle sets) and of the 128-bit set keys.

Null and empty texts (and texts without words) have an empty set and link with nothing, not
even each other; their component is their own id.  Repeated rows share a component.  Null ids
never name a component; a component of null ids alone has a null id.  ``kept`` is false for
null ids.  Ties between ids cannot matter (the least is taken).  A very long text is one set in one
row.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import Memo, batches_of, chunks, doc_texts, ragged, row_key, stage
from casebook.llm.components import components
from casebook.llm.word_arrays import TextBytes, word_array

BANDS, ROWS = 28, 5
BINS = BANDS * ROWS
CACHE_WORDS = 200_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(column: pa.Array, memo: Memo, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash.  ASCII lower
    case; a text with fewer than ``size`` words is one shingle."""
    words, row = word_array(TextBytes(column, lower=True))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U)
    coded = words.dictionary_encode()
    known = coded.dictionary.to_pylist()
    new = memo.need(set(known))
    memo.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    code = np.fromiter(map(memo.__getitem__, known), dtype=U, count=len(known))[coded.indices.to_numpy()]
    n = np.bincount(row, minlength=len(column))
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    # a short text's only shingle starts at its first word and ends with the text
    starts = np.flatnonzero((place + size <= n[row]) | (place == 0))
    value = np.zeros(len(starts), dtype=U)
    for i in range(size):
        there = place[starts] + i < n[row[starts]]
        nxt = code[np.minimum(starts + i, len(code) - 1)]
        value = np.where(there, mix(value * U(0x9E3779B97F4A7C15) + nxt + U(i + 1)), value)
    owner = row[starts]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]
    return owner[keep], value[keep]


def probes(attempt: int) -> np.ndarray:
    """The bin that each bin looks into at its ``attempt``-th try."""
    place = np.arange(BINS, dtype=U) * U(0x100000001B3) + U(attempt * 0x9E3779B97F4A7C15 % (1 << 64))
    return ((mix(place + U(1)) >> U(32)) % U(BINS)).astype(np.int64)


def signatures(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash of the sets 0..n-1 (each with a member), densified: (n, BINS)."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    spread = mix(value ^ U(0x5851F42D4C957F2D))
    bin_ = ((spread >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    out = np.full(n * BINS, empty)
    np.minimum.at(out, owner * BINS + bin_, mix(spread))
    out = out.reshape(n, BINS)
    filled = out != empty
    row, hole = np.nonzero(~filled)
    attempt = 0
    while len(row):
        other = probes(attempt)[hole]
        found = filled[row, other]
        out[row[found], hole[found]] = out[row[found], other[found]]
        row, hole = row[~found], hole[~found]
        attempt += 1
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    key = np.broadcast_to(np.arange(BANDS, dtype=U), (len(signature), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + signature[:, i::ROWS][:, :BANDS])
    return key


def _set_keys(value: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    raw = value.astype("<u8").tobytes()
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_MEMO = Memo(CACHE_WORDS)


def _sets(part: pa.RecordBatch, size: int):
    owner, value = shingle_sets(part.column("text"), _MEMO, size)
    n = np.bincount(owner, minlength=part.num_rows)
    return owner, value, n, _set_keys(value, np.r_[0, np.cumsum(n)])


def sketches(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, row (key of the row), x (key of its set; null: empty), n (set size) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                owner, value, n, keys = _sets(part, size)
                some = np.flatnonzero(n)
                rank = np.cumsum(n > 0) - 1
                bands = bands_of(signatures(rank[owner], value, len(some))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(keys, pa.binary()),
                     pa.array(n, pa.int64()), ragged(bands.ravel(), np.where(n > 0, BANDS, 0))],
                    names=["doc_id", "row", "x", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_texts(docs).withColumn("row", row_key()).mapInArrow(
        run, f"doc_id {kind}, row long, x binary, n long, bands array<long>")


def sets_of(docs: DataFrame, rows: DataFrame, size: int = 3) -> DataFrame:
    """x and ``shingles`` (sorted hashes) of the sets of the texts whose row key is in ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                _, value, n, keys = _sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), ragged(value.view(np.int64), n)], names=["x", "shingles"])

    wanted = doc_texts(docs).withColumn("row", row_key()).join(rows, "row", "left_semi")
    return wanted.select("text").mapInArrow(run, "x binary, shingles array<long>")


def star_edges(sets: DataFrame) -> DataFrame:
    """(a, x): each bucket's members under its centre, every edge once.  ``sets`` has x and bands."""
    rows = sets.select("x", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(rows.join(shared, ["band", "key"]))
    mates = members.groupBy("x").agg(F.sum("size").alias("mates"))
    centres = (members.join(mates, "x").groupBy("band", "key")
               .agg(F.max(F.struct("mates", "x")).alias("top")).select("band", "key", F.col("top.x").alias("a")))
    return members.join(centres, ["band", "key"]).where("a <> x").select("a", "x").distinct()


def _links(percent: int) -> str:
    return f"100 * common >= {percent} * (na + nx - common)"


def _beside_the_centre(stars: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one star that are in different components.

    ``stars`` has a, x, na, nx, added (x minus a), lost (a minus x), root_a, root_x.  With
    d = |D(x)|, o = |D(x) and D(y)| and n the set sizes, x and y link when
        (200 + 2p) o >= (100 + p)(d_x + d_y) - (100 - p)(n_x + n_y) = w(x) + w(y).
    Only a stray (a member outside its centre's component) and another member can still be
    an unknown link.  If the least w of the star meets w(x) without any overlap, x links to
    that member.  Every other link shares an element of the two prefixes."""
    p, scale = percent, 200 + 2 * percent
    d = F.concat("added", "lost")
    members = stars.select("a", "x", "root_x", d.alias("diff"), (F.col("root_x") != F.col("root_a")).alias("stray"),
                           ((100 + p) * F.size(d) - (100 - p) * F.col("nx")).alias("w"))
    least = (members.groupBy("a").agg(F.min(F.struct("w", "x", "root_x")).alias("nearest"),
                                      F.min(F.when(F.col("stray"), F.col("w"))).alias("stray_w"))
             .where("stray_w IS NOT NULL"))
    members = stage(members.join(least, "a"))
    certain = members.where("stray AND w + nearest.w <= 0 AND root_x <> nearest.root_x").select(
        F.col("x").alias("a"), F.col("nearest.x").alias("b"))

    items = members.select("a", "x", F.explode("diff").alias("e"))
    seen = items.groupBy("a", "e").agg(F.count(F.lit(1)).alias("seen"))
    ordered = (items.join(seen, ["a", "e"]).groupBy("a", "x")
               .agg(F.sort_array(F.collect_list(F.struct("seen", "e"))).alias("rarest")))

    def prefix(bound: str):
        need = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col(bound)) / scale))
        rest = F.greatest(F.lit(0), F.size("diff") - need + 1).cast("int")
        shared = F.filter(F.slice("rarest", F.lit(1), rest), lambda s: s["seen"] > 1)
        return F.explode(F.transform(shared, lambda s: s["e"]))

    listed = stage(members.drop("diff").join(ordered, ["a", "x"]).withColumn("diff", F.col("rarest.e")))
    left = listed.where("stray").select("a", F.col("x").alias("b"), F.col("root_x").alias("root_b"),
                                        prefix("nearest.w").alias("e"))
    right = listed.select("a", F.col("x").alias("c"), F.col("root_x").alias("root_c"), prefix("stray_w").alias("e"))
    pairs = left.join(right, ["a", "e"]).where("root_b <> root_c").select("a", "b", "c").distinct()
    own = listed.select("a", F.col("x").alias("b"), F.col("diff").alias("diff_b"), F.col("w").alias("w_b"))
    other = listed.select("a", F.col("x").alias("c"), F.col("diff").alias("diff_c"), F.col("w").alias("w_c"))
    found = (pairs.join(own, ["a", "b"]).join(other, ["a", "c"])
             .where(F.lit(scale) * F.size(F.array_intersect("diff_b", "diff_c")) >= F.col("w_b") + F.col("w_c"))
             .select(F.col("b").alias("a"), F.col("c").alias("b")))
    return certain.union(found).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; rows link when their sets'
    intersection holds at least ``percent`` of their union."""
    seen = stage(sketches(docs, size))
    sets = stage(seen.where("x IS NOT NULL").groupBy("x").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("first_id"), F.min("bands").alias("bands")))
    edges = stage(star_edges(sets))
    needed = edges.select("a").union(edges.select("x")).distinct().withColumnRenamed("a", "x")
    full = stage(sets_of(docs, sets.join(needed, "x").select("row").distinct(), size).dropDuplicates(["x"]))

    a = full.select(F.col("x").alias("a"), F.col("shingles").alias("sa"))
    x = full.select("x", F.col("shingles").alias("sx"))
    both = edges.join(a, "a").join(x, "x")
    measured = stage(both.select(
        "a", "x", F.size("sa").alias("na"), F.size("sx").alias("nx"),
        F.array_except("sx", "sa").alias("added"), F.array_except("sa", "sx").alias("lost"))
        .withColumn("common", F.col("nx") - F.size("added")))
    linked = measured.where(_links(percent)).select("a", F.col("x").alias("b"))
    rooted = stage(components(linked))                    # (a, b): node and its component's least

    def root_of(frame: DataFrame, node: str) -> DataFrame:
        found = rooted.select(F.col("a").alias(node), F.col("b").alias("_root"))
        return frame.join(found, node, "left").withColumn(
            f"root_{node}", F.coalesce("_root", node)).drop("_root")

    stars = root_of(root_of(measured, "a"), "x")
    later = stage(_beside_the_centre(stars, percent))
    if not later.isEmpty():
        rooted = components(linked.union(later))
    final = root_of(sets.select("x", "first_id"), "x")
    least = final.groupBy("root_x").agg(F.min("first_id").alias("component_id"))
    named = final.join(least, "root_x").select("x", "component_id")
    out = seen.where("x IS NOT NULL").join(named, "x").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.union(seen.where("x IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
