"""SimHash near-duplicates with pivot distance tables.

Each text becomes a fingerprint of 64 bits, or of several lanes of 64.  Equal fingerprints are one
class from then on, so copies cost one row.  For each distinct fingerprint a table row holds its
Hamming distances to ``PIVOTS`` reference fingerprints.  Distance tables cannot bucket by
themselves, so candidates meet first on equal keys; ``Rule`` says which.  Among the candidates,
pairs whose table rows differ by more than the limit in any coordinate are discarded (triangle
inequality), survivors are verified bit by bit, and each group of over 32 candidates passes on only
a spanning forest of its links.  A key with more than ``TILE`` fingerprints is dealt out as all pairs
of its random parts, so no task holds a whole hot group and no pair of it is left out.  Components
come from alternating star contraction.

``STRICT`` (64 bits, three-word shingles, three bits) takes as keys the ten pairs of five bit blocks:
two fingerprints within three bits agree on two whole blocks at least, so no link is missed.
``SIMILAR`` (256 bits, five-word shingles) links texts whose sets of shingles overlap by 0.8 or more
(common by all, as sets).  Its nodes are distinct sets, its keys 16 bands of five minimum hashes: texts
at 0.8 meet with a chance of 99.8 %, at 0.85 of 99.99 %.  Keys with the same members are worked on once.
Fingerprints only discard: the limit of 76 bits is six deviations over the mean at 0.8 (39 bits), and
what passes is verified by the overlap itself, so no pair below 0.8 is linked.

Defined cases: a text that is null or has no words has fingerprint zero and is linked like any
other; repeated rows give repeated rows; a null id takes part in linking but names no component
unless all ids of its component are null, whose component is then null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, free_name, map_texts, texts_of, written

TILE = 1024
PIVOTS = 16
SEED = 42
#: Bit blocks as (lowest bit, width); with at most three differing bits two of five stay whole.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


@dataclass(frozen=True)
class Rule:
    """What links two texts: words in a shingle, lanes of 64 bits, differing bits allowed, the keys that
    candidates share (0 tables: pairs of ``BLOCKS``, else so many bands of ``minima`` minimum hashes), and
    the least overlap of their sets of shingles (0: the bits decide)."""

    size: int = 3
    lanes: int = 1
    max_bits: int = 3
    tables: int = 0
    minima: int = 5
    overlap: float = 0.0


STRICT = Rule()
SIMILAR = Rule(size=5, lanes=4, max_bits=76, tables=16, overlap=0.8)
#: Bits of a hash that choose a text's place in the bitmap of wanted texts.
WANTED_BITS = 26

_SIGN = 1 << 63


def signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def _pivots(lanes: int) -> np.ndarray:
    """Reference fingerprints: pseudo-random, the same in every run."""
    import xxhash

    return np.array([[xxhash.xxh64_intdigest(f"pivot {i} {k}", seed=SEED) for k in range(lanes)] for i in range(PIVOTS)], dtype=np.uint64)


def _lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles for each lane but the first."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Hashes of a text's shingles, in its order."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    n = max(1, len(words) - size + 1)
    return np.fromiter((xxhash.xxh64_intdigest(s, seed=SEED) for s in grams), dtype=np.uint64, count=n)


def fingerprint(text: str, rule: Rule = STRICT) -> np.ndarray:
    """One unsigned 64-bit number a lane: a bit is 1 if set in over half of the shingles' hashes."""
    return _bits(shingles(text, rule.size), rule)


def _bits(hashes: np.ndarray, rule: Rule) -> np.ndarray:
    out, n = np.zeros(rule.lanes, dtype=np.uint64), len(hashes)
    if not n:
        return out
    for k in range(rule.lanes):
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, n, 1 << 16):
            part = _lane(hashes[i : i + (1 << 16)], k).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def node_of(bits: np.ndarray) -> int:
    """The node of a fingerprint or a set: itself if it is one number, else its hash."""
    import xxhash

    return signed(int(bits[0]) if len(bits) == 1 else xxhash.xxh64_intdigest(bits.tobytes()))


def node(text: str, rule: Rule) -> int:
    """A text's node: of its fingerprint, or of its set of shingles if their overlap decides."""
    return node_of(np.unique(shingles(text, rule.size))) if rule.overlap else node_of(fingerprint(text, rule))


def fingerprints(docs: DataFrame, rule: Rule = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint, bits binary): the fingerprint's node and its lanes, little-endian."""

    def make() -> Callable:
        def helper(texts: list[str]) -> list:
            all_bits = [fingerprint(t, rule) for t in texts]
            return [pa.array([node_of(b) for b in all_bits], pa.int64()), pa.array([b.tobytes() for b in all_bits], pa.binary())]

        return helper

    return map_texts(texts_of(docs, id_col, text_col), make, "fp bigint, bits binary")


def _keys(bits: np.ndarray) -> np.ndarray:
    """A column of candidate keys for each pair of blocks, the pair's number in the high bits."""
    block = [(bits[:, 0] >> np.uint64(low)) & np.uint64((1 << width) - 1) for low, width in BLOCKS]
    pairs = [(block[a] << np.uint64(13)) | block[b] for a, b in combinations(range(5), 2)]
    return np.stack([k | np.uint64(n << 40) for n, k in enumerate(pairs)], axis=1)


def band_keys(found: np.ndarray, rule: Rule) -> np.ndarray:
    """A candidate key for each band of minimum hashes of a set; none for the empty set."""
    if not len(found):
        return found
    rng = np.random.default_rng(SEED)
    many = rule.tables * rule.minima
    by, plus = rng.integers(0, 1 << 63, (2, many), dtype=np.uint64)
    by = by << np.uint64(1) | np.uint64(1)
    low = np.full(many, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 1 << 12):
        x = found[i : i + (1 << 12), None] * by + plus
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    key = np.arange(1, rule.tables + 1, dtype=np.uint64)
    for column in low.reshape(rule.tables, rule.minima).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key


def marks(df: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, th, fp, keys) of (doc_id, text): the text's hash, its set's node and candidate keys."""

    def make() -> Callable:
        def helper(texts: list[str]) -> list:
            sets = [np.unique(shingles(t, rule.size)) for t in texts]
            keys = [band_keys(x, rule).view(np.int64) for x in sets]
            return [pa.array([node_of(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]

        return helper

    return map_texts(df.withColumn("th", _text_hash()), make, "fp bigint, keys array<bigint>")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _away(bits: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(bits ^ p).sum(axis=1) for p in pivots], axis=1).astype("<i2")


def pivot_tables(distinct: DataFrame, rule: Rule) -> DataFrame:
    """(fp, bits, piv binary, keys array<bigint>) of distinct fingerprints: their distances to the pivots
    as 16-bit numbers, and their candidate keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _pivots(rule.lanes)
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, rule.lanes)
            away = _away(bits, pivots)
            keys = _keys(bits).view(np.int64)
            offsets = pa.array(np.arange(len(bits) + 1, dtype=np.int32) * keys.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), batch.column("bits"), pa.array([x.tobytes() for x in away], pa.binary()), lists], ["fp", "bits", "piv", "keys"]
            )

    return distinct.select("fp", "bits").mapInArrow(run, "fp bigint, bits binary, piv binary, keys array<bigint>")


@dataclass(frozen=True)
class _Rows:
    """Fingerprints, their pivot distances and, if overlaps decide, their sets of shingles."""

    bits: np.ndarray
    table: np.ndarray
    sets: list[np.ndarray] | None
    rule: Rule

    def part(self, start: int, stop: int) -> _Rows:
        return _Rows(self.bits[start:stop], self.table[start:stop], self.sets and self.sets[start:stop], self.rule)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs pass the pivot filter, then the exact distance and the overlap."""
        keep, most = np.arange(len(i)), self.rule.max_bits
        for c in range(self.table.shape[1]):
            keep = keep[np.abs(self.table[i[keep], c] - self.table[j[keep], c]) <= most]
        keep = keep[np.bitwise_count(self.bits[i[keep]] ^ self.bits[j[keep]]).sum(axis=1) <= most]
        if self.sets is None:
            return keep
        pairs = zip(i[keep].tolist(), j[keep].tolist(), strict=True)
        return keep[np.fromiter((overlaps(self.sets[x], self.sets[y], self.rule.overlap) for x, y in pairs), dtype=bool, count=len(keep))]


def overlaps(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this share of all their members in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) / len(b) < least:
        return len(a) == len(b)
    common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return common / (len(a) + len(b) - common) >= least


def _forest_large(rows: _Rows) -> list[tuple[int, int]]:
    """Spanning forest of one group: breadth first, each member compared with those not yet reached."""
    left, edges = np.arange(len(rows.bits)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = rows.near(np.full(len(left), x), left)
            edges += [(x, y) for y in left[near].tolist()]
            queue += left[near].tolist()
            left = np.delete(left, near)
    return edges


def _forest(group: np.ndarray, rows: _Rows) -> np.ndarray:
    """Index pairs that span the links inside each run of equal ``group`` (sorted)."""
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((begin, [len(group)])))
    edges: list[tuple[int, int]] = []
    large = sizes > 32
    for b, n in zip(begin[large].tolist(), sizes[large].tolist(), strict=True):
        edges += [(b + x, b + y) for x, y in _forest_large(rows.part(b, b + n))]
    i, d = np.flatnonzero(np.repeat(~large, sizes)), 1
    while len(i):
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        near = rows.near(i, i + d)
        edges += list(zip(i[near].tolist(), (i[near] + d).tolist(), strict=True))
        d += 1
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def _group_links(rule: Rule) -> Callable:
    """Rows sorted by (key, a, b) to links (x, y) between fingerprints; groups may span batches."""
    group = ("key", "a", "b")

    def links_of(t: pa.Table) -> pa.RecordBatch:
        change = np.zeros(t.num_rows, dtype=bool)
        for c in group:
            v = t.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, rule.lanes)
        table = np.frombuffer(b"".join(t.column("piv").to_pylist()), dtype="<i2").reshape(-1, PIVOTS)
        fp = t.column("fp").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").to_pylist()] if rule.overlap else None
        e = _forest(np.cumsum(change), _Rows(bits, table, sets, rule))
        return pa.RecordBatch.from_arrays([pa.array(fp[e[:, 0]]), pa.array(fp[e[:, 1]])], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            same = np.ones(held.num_rows, dtype=bool)
            for c in group:
                v = held.column(c).to_numpy()
                same &= v == v[-1]
            ready = int(np.argmax(same))
            if ready:
                yield links_of(held.slice(0, ready))
                held = held.slice(ready)
        if held is not None:
            yield links_of(held)

    return run


def links(distinct: DataFrame, rule: Rule = STRICT, tile: int = TILE) -> DataFrame:
    """(x, y): links between the distinct fingerprints (fp, bits), enough to span every component."""
    tables = pivot_tables(distinct, rule)
    dealt = _dealt(tables, tile).join(tables.select("fp", "bits", "piv"), "fp")
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_group_links(rule), "x bigint, y bigint")


def _dealt(tables: DataFrame, tile: int, once: bool = False) -> DataFrame:
    """(key, a, b, fp): the groups of (fp, keys) that share a key, large ones as all pairs of their parts.
    ``once``: of keys with the same members only one is kept."""
    rows = tables.select("fp", F.explode("keys").alias("key"))
    own = [F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"s{k}") for k in range(2 * once)]
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), *own).filter("n > 1")
    if once:
        counts = counts.groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key", "n")
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", "key"), parts).cast("int")
    return (
        rows.join(counts, "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )


def overlap_links(distinct: DataFrame, texts: DataFrame, rule: Rule, tile: int = TILE) -> DataFrame:
    """As ``links``, for sets (fp, keys, th) of ``texts``, verified by their overlap.  Sets are made again
    for the texts that share a key, so no other text moves."""
    dealt = written(_dealt(distinct, tile, once=True))
    wanted = written(distinct.select("fp", "th").join(dealt.select("fp").distinct(), "fp"))
    place = F.shiftrightunsigned("th", 64 - WANTED_BITS)
    found = wanted.groupBy(F.shiftright(place, 15).alias("at")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("map")).collect()
    bitmap = np.zeros((1 << (WANTED_BITS - 15), 4096), dtype=np.uint8)
    for r in found:
        bitmap[r["at"]] = np.frombuffer(r["map"], dtype=np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.ravel())

    @F.pandas_udf("boolean")
    def is_wanted(th: pd.Series) -> pd.Series:
        at = th.to_numpy().view(np.uint64) >> np.uint64(64 - WANTED_BITS)
        return pd.Series(shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1)

    def make() -> Callable:
        pivots = _pivots(rule.lanes)

        def helper(some: list[str]) -> list:
            sets = [np.unique(shingles(t, rule.size)) for t in some]
            bits = np.array([_bits(x, rule) for x in sets], dtype=np.uint64).reshape(-1, rule.lanes)
            return [pa.array([x.tobytes() for x in part], pa.binary()) for part in (bits, _away(bits, pivots), sets)]

        return helper

    some = texts.select(_text_hash().alias("th"), "text").filter(is_wanted("th")).groupBy("th").agg(F.first("text").alias("text")).join(wanted, "th")
    made = map_texts(some, make, "bits binary, piv binary, set binary", drop=("th", "text"))
    groups = dealt.join(made, "fp").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return groups.mapInArrow(_group_links(rule), "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (x, y) but the roots, with the smallest node it reaches.

    Alternating large-star and small-star contraction: every round is aggregations and joins, and
    its result is checkpointed, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        from tidemark.llm.common import shared_dir

        spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct().checkpoint()
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Checkpointed, the smaller side has no partitioning of its own, so Spark can split the rows of a node with many links.
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")).checkpoint()
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = small.select("e.u", "e.v").filter("u <> v").distinct().checkpoint()
        before, now = now, state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, rule: Rule = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each document; component_id is the smallest id it is linked to."""
    if rule.overlap:
        texts = texts_of(docs, id_col, text_col)
        fps = written(marks(texts, rule))
        distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"), F.min("th").alias("th"))
        roots = components(overlap_links(distinct, texts, rule))
    else:
        fps = written(fingerprints(docs, rule, id_col, text_col))
        distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("bits").alias("bits"))
        roots = components(links(distinct.select("fp", "bits"), rule))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # Written, so that neither side of the join by root is bound to a partitioning and Spark can split a large component.
    lows = written(classes.groupBy("root").agg(F.min("low").alias("component_id")))
    return fps.select("doc_id", "fp").join(classes.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, rule: Rule = SIMILAR) -> DataFrame:
    """One document of each component, all columns kept: the one with the smallest id.

    Rows without an id whose whole component has none are kept once for each fingerprint; rows
    that repeat an id count as copies of it.
    """
    classes = near_duplicates(docs, rule)
    keep = classes.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return kept
    text, fp = free_name(docs, "as_text"), free_name(docs, "print")
    lone = classes.filter("component_id is null").select(F.col("fp").alias(fp)).distinct()
    prints = map_texts(
        nameless.withColumn(text, F.col("text").cast("string")),
        lambda: lambda texts: [pa.array([node(t, rule) for t in texts], pa.int64())],
        f"{fp} bigint",
        drop=(text,),
        text=text,
    )
    once = prints.join(lone, fp, "left_semi").dropDuplicates([fp])
    return kept.unionByName(once.select(*docs.columns))


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 lowercase hex digits."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
