"""Alignment of two tokenizers' tokens, with corpus-wide counts of the pairs that overlap.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces with byte fallback) the text, before
which it puts a space itself.  Both token sequences then spell the same bytes; an A and a B token whose byte ranges
overlap are linked, and the offsets where both end a token cut the sequences into groups.

First pass: each task aligns its documents and counts its pairs of ids, in buckets of B ids.  A bucket's distinct
pairs are united up a tree of tasks and get a minimal perfect hash (levels of bit arrays; a key lives in the first
level where no other key of that level shares its place, and its number is the bit's rank), 3 to 4 bits a pair.
The tasks' counts become dense vectors indexed by that hash, summed up the same tree.  Second pass: documents are
aligned again and their pairs looked up; the key stored under the number confirms each hit.

Both tokenizers end a token before a space that follows a character which is not white space, since neither the
pattern of A nor any piece of B reaches across such a place (checked when the files are loaded).  So texts are cut
there, and each worker keeps a bounded memo of the aligned segments.

Size: pairs are pairs of vocabulary entries whose bytes agree, so their number has a bound that does not grow with the
corpus.  The lookup table is sent out in blocks of ``BLOCK_PAIRS`` at most; with more pairs the second pass runs once
for each block and the blocks' sums are added.

Defined cases: null and empty texts, and texts whose bytes a tokenizer changes (U+2581, which B reads as a space), have
no tokens: zeros, no groups, and no part in the counts.  Repeated rows count and return once each.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, remove, shared_dir, texts_of

BUCKETS = 16
#: Staged rows that one task of the tree folds into one.
FAN = 32
#: Distinct pairs that a task holds before it hands its counts on.
TASK_PAIRS = 4_000_000
#: Pairs of the table that a worker holds at once, 13 bytes each.
BLOCK_PAIRS = 4_000_000
#: Segments in a memo's younger half, and the longest one that it takes.
MEMO = 200_000
MEMO_CHARS = 64
#: Text bytes whose segments are numbered together.
ALIGNED_BYTES = 4 << 20
#: Bits for each key in a level of the hash.
SPARSE = 2

#: What may stand before a cut: characters that no library takes for white space.
_INK = "!-~\u00c0-\u024f"
_CUT = re.compile(f"(?<=[{_INK}])(?= )")
#: What may be white space to some library; after anything else a space is a cut.
_WHITE = "\\x09-\\x0d \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}"
#: Segments of characters on whose class every library's tables agree, which begin and end as a cut asks.
_COMMON = re.compile(f" [\\t\\n\\r -~\u00c0-\u024f]*[{_INK}]")
#: Stand for a cut while texts are split: code points that are no characters; one that no text of a slice holds is taken.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]
#: Segments that are encoded as one string.
JOINED = 32
_SPACE = "▁"

_state: dict = {}


def byte_letters() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable bytes stand for themselves, the others
    take the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class Tokenizers:
    """Both tokenizers' files, shipped to tasks; what is made of them is kept by each worker."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str):
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            self.shared = spark.sparkContext.broadcast((a.read(), b.read()))
        self.key = (a_path, b_path)

    def pair(self) -> Pair:
        if _state.get("key") != self.key:
            _state.clear()
            _state.update(key=self.key, pair=Pair(*self.shared.value))
        return _state["pair"]


class Pair:
    """Two tokenizers in a worker: ``align`` gives segments' links and groups."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core is all it has
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        model, letters = json.loads(a_file)["model"], byte_letters()
        entries = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merges]
        # Where merges are ranked by id, the ranks are all there is to know; else the library encodes every segment.
        self.ranked = None
        if ids == sorted(ids) and len(entries) == len(model["vocab"]) and len(ids) + 256 == len(entries):
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=None, model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("a piece of B reaches across a space")
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for raw, i in entries.items():
            self.a_bytes[i] = raw
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.width = len(pieces)
        names = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        self.named = [[n + m for n in names] for m in (",", "|", ";", "")]
        self.digits = np.array([len(x) for x in names])
        self.blank = self.b.piece_to_id(_SPACE)
        self.memos: dict = {}

    def encoded(self, segment: str) -> tuple[list[int], list[int]] | None:
        """Ids of a segment, which begins with a space, by A and by B; None where the bytes of either are others."""
        a = self.a.encode(segment, add_special_tokens=False).ids
        b = self.b.encode(segment[1:], num_threads=1) if len(segment) > 1 else [self.blank]
        return (a, b) if self._spell(a, b, segment) else None

    def _spell(self, a: list[int], b: list[int], text: str) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == text.encode() == b"".join(map(self.b_bytes.__getitem__, b))

    def _joined(self, parts: list[list[str]]) -> Iterator[tuple[list[int], list[int]] | None]:
        """For each list of common segments: the ids of all of them, encoded as one text; None if they don't spell it."""
        texts = ["".join(p) for p in parts]
        a = [self.ranked(t) for t in texts] if self.ranked else [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        for t, x, y in zip(texts, a, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            yield (x, y) if self._spell(x, y, t) else None

    def align(self, found: list[str], spelled: bool = True) -> Aligned:
        """All of some segments at once."""
        common = [bool(len(s) < 10_000 and _COMMON.fullmatch(s)) for s in found]
        joined = [k for k, ok in enumerate(common) if ok]
        parts = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        lone = [k for k, ok in enumerate(common) if not ok]
        order, a, b, bad = [], [], [], []
        for ks, got in zip(parts, self._joined([[found[k] for k in p] for p in parts]) if parts else (), strict=True):
            if got is None:
                lone += ks
                continue
            order += ks
            a += got[0]
            b += got[1]
        for k in lone:
            got = self.encoded(found[k])
            if got is None:
                bad.append(k)
                continue
            order.append(k)
            a += got[0]
            b += got[1]
        return Aligned(self, [found[k] for k in order], order + bad, np.array(a, np.int64), np.array(b, np.int64), spelled)

    def memo(self, name: object) -> list[dict]:
        """The two halves of a memo; a worker keeps the latest memo only."""
        if name not in self.memos:
            self.memos = {name: [{}, {}]}
        return self.memos[name]


class Aligned:
    """Segments' tokens side by side.  ``order`` names the segments by their places in the list that was asked for, those
    without tokens last; everything else is in that order."""

    def __init__(self, pair: Pair, texts: list[str], order: list[int], a: np.ndarray, b: np.ndarray, spelled: bool):
        self.order, n, more = order, len(texts), len(order) - len(texts)
        ends = np.cumsum(pa.compute.binary_length(pa.array(texts, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64))
        a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
        a_starts, b_starts = a_ends - pair.a_sizes[a], b_ends - pair.b_sizes[b]
        # The segment of each token, and where the tokens of each segment end.
        a_of, b_of = np.searchsorted(ends, a_starts, "right"), np.searchsorted(ends, b_starts, "right")
        low, high = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
        each = high - low
        left = np.repeat(np.arange(len(a)), each)
        right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
        self.links = (a[left] * pair.width + b[right]).astype(np.uint64)
        count = lambda of: np.concatenate((np.bincount(of, minlength=n), np.zeros(more, np.int64)))
        self.n_a, self.n_b, self.n_links = count(a_of), count(b_of), count(a_of[left])
        # A group ends where both sides do.
        a_cut, b_cut = np.isin(a_ends, b_ends), np.isin(b_ends, a_ends)
        self.n_groups = count(a_of[a_cut])
        self.link_ends = np.cumsum(self.n_links)
        if spelled:
            self.texts = self._spelled(pair, a, b, np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut) + [""] * more

    def _spelled(self, pair: Pair, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
        """Each segment's groups: ids parted by commas, sides by a bar, groups by semicolons."""
        side = np.concatenate((2 * a_group, 2 * b_group + 1))
        at = np.argsort(side, kind="stable")
        ids, side = np.concatenate((a, b))[at], side[at]
        last = np.append(side[1:] != side[:-1], True)[: len(side)]
        mark = np.where(~last, 0, 1 + side % 2)
        n = len(self.n_groups) - np.count_nonzero(self.n_a == 0)
        tokens = np.cumsum((self.n_a + self.n_b)[:n])
        mark[tokens - 1] = 3  # a segment's last token
        named = pair.named
        text = "".join([named[m][i] for i, m in zip(ids.tolist(), mark.tolist(), strict=True)])
        ends = np.cumsum(pair.digits[ids] + (mark < 3))[tokens - 1].tolist()
        return [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def segments(text: str) -> list[str]:
    """A space and the text, cut before each space that follows a common character which is not white space."""
    return _CUT.split(" " + text)


def _recalled(memo: list[dict], found: list[str], make: Callable[[list[str]], list]) -> list:
    """What the memo has for distinct segments; ``make`` gives the rest.  The younger half becomes the older one when full."""
    if len(memo[0]) > MEMO:
        memo[:] = [{}, memo[0]]
    young, old = memo
    out, new = list(map(young.get, found)), []
    for k in [k for k, x in enumerate(out) if x is None]:
        x = old.get(found[k])
        if x is None:
            new.append(k)
        else:
            out[k] = young[found[k]] = x
    for k, x in zip(new, make([found[k] for k in new]), strict=True):
        out[k] = x
        if len(found[k]) <= MEMO_CHARS:
            young[found[k]] = x
    return out


def _numbered(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Where each text's segments end, the distinct segments, each segment's number among them, and which texts are not empty."""
    texts = texts.fill_null("")
    filled = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    spaced = pa.compute.binary_join_element_wise(" ", texts, "")
    mark = next((m for m in _MARKS if not pa.compute.any(pa.compute.match_substring(texts, m)).as_py()), None)
    if mark:
        # Most texts have no white space before a space: there every space but the first is a cut.
        plain = pa.compute.replace_substring(spaced, " ", f"{mark} ")
        after = pa.compute.match_substring_regex(spaced, f"[{_WHITE}] ")
        if pa.compute.any(after).as_py():
            plain = pa.compute.if_else(after, pa.compute.replace_substring_regex(pa.compute.if_else(after, spaced, ""), f"([{_INK}]) ", f"\\1{mark} "), pa.compute.utf8_slice_codeunits(plain, 1))
        else:
            plain = pa.compute.utf8_slice_codeunits(plain, 1)
        cut = pa.compute.split_pattern(plain, mark)
    else:
        cut = pa.array([segments(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    every = cut.flatten().dictionary_encode()
    return offsets[1:] - offsets[0], every.dictionary.to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy().astype(np.int64), filled


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs that end at ``ends``."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def _whole(bad: np.ndarray, ends: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Texts that are not empty and have no bad segment."""
    return (_sums(bad.astype(np.int64), ends) == 0) & filled


# Minimal perfect hash


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of each key, others on each level."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 .. n - 1 of n distinct keys, from bit arrays alone; any other key gets some number or -1."""

    def __init__(self, levels: list[bytes]):
        self.words = [np.frombuffer(x, dtype="<u8") for x in levels]
        self.ranks, n = [], 0
        for w in self.words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.ranks.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.n = n

    @staticmethod
    def levels(keys: np.ndarray) -> list[bytes]:
        out = []
        while len(keys):
            size = 64 * -(-SPARSE * len(keys) // 64)
            at = (mixed(keys, len(out)) % np.uint64(size)).astype(np.int64)
            met = np.bincount(at, minlength=size)
            out.append(np.packbits(met == 1, bitorder="little").tobytes())
            keys = keys[met[at] > 1]
        return out

    def number(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks, strict=True)):
            if not len(rest):
                break
            at = (mixed(keys[rest], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (ranks[at >> 6] + below)[hit]
            rest = rest[~hit]
        return out


# First pass


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and where it is."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _stage(docs: DataFrame, toks: Tokenizers) -> DataFrame:
    """(bucket, part, keys, counts): each task's pairs and how often it met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = toks.pair()
        width = np.uint64(pair.width)
        memo = pair.memo("pairs")
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        part = TaskContext.get().partitionId()

        def make(new: list[str]) -> list[bytes]:
            got = pair.align(new, False)
            raw, out = got.links.tobytes(), [b""] * len(new)
            start = 0
            for k, end in zip(got.order, (8 * got.link_ends).tolist(), strict=True):
                out[k] = raw[start:end]
                start = end
            return out

        def flushed() -> Iterator[pa.RecordBatch]:
            bucket = (keys % width).astype(np.int64) % BUCKETS
            for k in np.unique(bucket):
                own = bucket == k
                row = [[k], [part], [keys[own].tobytes()], [counts[own].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "keys", "counts"])

        for batch in batches:
            for rows in byte_slices(batch, "text", ALIGNED_BYTES):
                ends, found, numbers, filled = _numbered(rows.column("text"))
                links = _recalled(memo, found, make)
                sizes = np.array([len(x) for x in links], np.int64) // 8
                whole = _whole(sizes[numbers] == 0, ends, filled)
                times = np.bincount(numbers[np.repeat(whole, np.diff(ends, prepend=0))], minlength=len(found))
                met, at = np.unique(np.concatenate((keys, np.frombuffer(b"".join(links), np.uint64))), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, np.repeat(times, sizes))), len(met)).astype(np.int64)
                keys, counts = met[counts > 0], counts[counts > 0]
                if len(keys) > TASK_PAIRS:
                    yield from flushed()
                    keys, counts = keys[:0], counts[:0]
        yield from flushed()

    return docs.select("text").mapInArrow(run, "bucket int, part int, keys binary, counts binary")


def _folded(rows: DataFrame, groups: int, start: Callable, add: Callable, end: Callable, shape: str) -> DataFrame:
    """One row for each bucket and part modulo ``groups``; rows of a group stream through one accumulator."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in end(held, at[0]))], names)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                here = row["bucket"], row["part"]
                if here != at:
                    if at is not None:
                        yield made()
                    at, held = here, start(here[0])
                held = add(held, row)
        if at is not None:
            yield made()

    dealt = rows.withColumn("part", (F.col("part") % groups).cast("int")).repartition("bucket", "part")
    return dealt.sortWithinPartitions("bucket", "part").mapInArrow(run, shape)


def _up(parts: int) -> Iterator[int]:
    """Groups of the tree's levels, down to one."""
    while parts > 1:
        parts = -(-parts // FAN)
        yield parts


def _tables(staged: DataFrame) -> DataFrame:
    """(bucket, part, keys, counts): a bucket's pairs in the order of its hash and their counts over all rows."""
    spark = staged.sparkSession
    parts = (staged.agg(F.max("part")).first()[0] or 0) + 1
    tree = [*_up(parts)] or [1]

    united = staged.select("bucket", "part", "keys")
    shape = "bucket int, part int, keys binary"
    for groups in tree:
        united = _folded(
            united, groups, lambda _: np.zeros(0, np.uint64), lambda held, row: np.union1d(held, np.frombuffer(row["keys"], np.uint64)), lambda held, _: [held.tobytes()], shape
        )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = PerfectHash.levels(np.frombuffer(row["keys"], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), pa.array([levels], pa.list_(pa.binary()))], ["bucket", "levels"])

    # A row for each bucket, 3 to 4 bits for each pair of vocabulary entries.
    levels = {r["bucket"]: [bytes(x) for x in r["levels"]] for r in united.mapInArrow(hashed, "bucket int, levels array<binary>").collect()}
    shared = spark.sparkContext.broadcast(levels)

    # The first level of the tree turns tasks' pairs into vectors, the others add vectors.
    def start(bucket: int):
        h = PerfectHash(shared.value[bucket])
        return h, np.zeros(h.n, np.int64), np.zeros(h.n, np.uint64)

    def add_pairs(held, row):
        h, total, keys = held
        own = np.frombuffer(row["keys"], np.uint64)
        at = h.number(own)
        total[at] += np.frombuffer(row["counts"], np.int64)
        keys[at] = own
        return held

    def add_vectors(held, row):
        h, total, keys = held
        total += np.frombuffer(row["counts"], np.int64)
        np.maximum(keys, np.frombuffer(row["keys"], np.uint64), out=keys)  # a place that a task never met is 0
        return held

    shape = "bucket int, part int, keys binary, counts binary"
    summed = staged
    for k, groups in enumerate(tree):
        summed = _folded(summed, groups, start, add_vectors if k else add_pairs, lambda held, _: [held[2].tobytes(), held[1].tobytes()], shape)
    return summed


class Table:
    """A block of buckets in a worker: counts and whether they are their B id's best, under the perfect hash."""

    def __init__(self, rows: dict[int, tuple], width: int):
        self.width = width
        self.buckets = {b: (PerfectHash(levels), np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(best, bool)) for b, (levels, keys, counts, best) in rows.items()}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, best) of each key; 0 and False for keys that are not in this block."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        bucket = (keys % np.uint64(self.width)).astype(np.int64) % BUCKETS
        for b, (h, stored, counts, bests) in self.buckets.items():
            own = np.flatnonzero(bucket == b)
            if len(own) and h.n:
                at = h.number(keys[own])
                hit = (at >= 0) & (stored[at] == keys[own])
                count[own[hit]], best[own[hit]] = counts[at[hit]], bests[at[hit]]
        return count, best


def _best(keys: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    b = (keys % np.uint64(width)).astype(np.int64)
    top = np.zeros(width, np.int64)
    np.maximum.at(top, b, counts)
    return counts == top[b]


def pair_counts(docs: DataFrame, toks: Tokenizers, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n) of every pair of ids that some document links; the tables of the first pass as rows."""
    width = toks.pair().width
    staged, _ = _kept(_stage(docs.select(F.col(text_col).cast("string").alias("text")), toks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((keys // np.uint64(width)).astype(np.int64)), pa.array((keys % np.uint64(width)).astype(np.int64)), pa.array(np.frombuffer(row["counts"], np.int64))], ["a_id", "b_id", "n"])

    return _tables(staged).mapInArrow(run, "a_id bigint, b_id bigint, n bigint")


def _blocks(docs: DataFrame, toks: Tokenizers, block: int) -> list:
    """Broadcasts of the lookup table, each of ``block`` pairs at most (or one bucket)."""
    spark = docs.sparkSession
    staged, staged_path = _kept(_stage(docs, toks))
    tables, path = _kept(_tables(staged))
    remove(spark, staged_path)
    width = toks.pair().width
    blocks, rows, size = [], {}, 0
    # One block of the table at a time is on the driver.
    for r in tables.select("bucket", (F.octet_length("keys") / 8).cast("long").alias("n")).orderBy("bucket").collect():
        if rows and size + r["n"] > block:
            blocks.append(rows)
            rows, size = {}, 0
        rows[r["bucket"]] = None
        size += r["n"]
    blocks.append(rows)
    out = []
    for rows in blocks:
        for r in tables.filter(F.col("bucket").isin(list(rows))).collect() if rows else []:
            keys, counts = (np.frombuffer(r[c], t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
            rows[r["bucket"]] = (PerfectHash.levels(keys), keys.tobytes(), counts.tobytes(), _best(keys, counts, width).tobytes())
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(rows)))
    remove(spark, path)
    return out


# Second pass

_COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _looked_up(docs: DataFrame, toks: Tokenizers, name: str, shared, groups: bool) -> DataFrame:
    """``docs`` with the counts of ``_COUNTED`` under one block of the table, and the groups as text, instead of its text."""
    keep = [c for c in docs.columns if c != "text"]
    shape = ", ".join([*(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes), *(f"{c} bigint" for c in _COUNTED), *["groups string"] * groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = toks.pair()
        memo = pair.memo(name)
        tables = pair.memos.setdefault("table", {})
        if name not in tables:
            tables.clear()
            tables[name] = Table(shared.value, pair.width)
        table = tables[name]

        def make(new: list[str]) -> list[tuple]:
            got = pair.align(new, groups)
            count, best = table.look_up(got.links)
            sums = [_sums(x, got.link_ends) for x in (best.astype(np.int64), count)]
            rows = np.column_stack((got.n_a, got.n_b, got.n_groups, got.n_links, *sums)).tolist()
            out: list = [None] * len(new)
            for k, row, text in zip(got.order, rows, got.texts if groups else [""] * len(new), strict=True):
                out[k] = row, text
            return out

        for batch in batches:
            for rows in byte_slices(batch, "text", ALIGNED_BYTES):
                ends, found, numbers, filled = _numbered(rows.column("text"))
                known = _recalled(memo, found, make)
                each = np.array([x[0] for x in known], np.int64).reshape(-1, 6)
                whole = _whole(each[numbers, 0] == 0, ends, filled)
                arrays = [pa.array(_sums(each[numbers, k], ends) * whole) for k in range(6)]
                if groups:
                    words, n, start, texts = [x[1] for x in known], numbers.tolist(), 0, []
                    for end, ok in zip(ends.tolist(), whole.tolist(), strict=True):
                        texts.append(";".join([words[k] for k in n[start:end]]) if ok else "")
                        start = end
                    arrays.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *arrays], [*keep, *_COUNTED, *["groups"] * groups])

    return docs.mapInArrow(run, shape)


def align(docs: DataFrame, toks: Tokenizers, block: int = BLOCK_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document.

    ``groups`` holds the ids of both sides, groups parted by semicolons, sides by a bar; empty without tokens.
    A link is best if no other pair of its B id is linked more often in all documents; ``count_sum`` adds up the counts of
    the document's links.
    """
    df = texts_of(docs, id_col, text_col)
    blocks = _blocks(df.select("text"), toks, block)
    if len(blocks) == 1:
        return _looked_up(df, toks, *blocks[0], True)
    # The same rows for each block, told apart by a number of their own.
    numbered, _ = _kept(df.withColumn("__row", F.monotonically_increasing_id()))
    first, *rest = [_looked_up(numbered, toks, *b, k == 0) for k, b in enumerate(blocks)]
    more = rest[0].select("__row", "n_best", "count_sum")
    for x in rest[1:]:
        more = more.unionByName(x.select("__row", "n_best", "count_sum"))
    more = more.groupBy("__row").agg(F.sum("n_best").alias("__best"), F.sum("count_sum").alias("__sum"))
    joined = first.join(more, "__row")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("__best")).alias("n_best"), (F.col("count_sum") + F.col("__sum")).alias("count_sum"), "groups")


def op13(docs: DataFrame, toks: Tokenizers) -> DataFrame:
    """The contract's columns; the groups' digest is '' without tokens."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align(docs, toks).withColumn("groups_sha256", digest).drop("groups")
