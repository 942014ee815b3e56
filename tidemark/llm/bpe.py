"""Byte-level BPE over whole texts: chunk, pre-tokenise, stitch, encode the pieces, decode.

Texts of at most ``chunk`` + ``overlap`` code points are one piece.  A longer text is cut at
multiples of ``chunk`` into chunks that overlap the next one by ``overlap``; chunks are dealt over
the cluster and pre-tokenised independently.  A chunk that starts inside a pre-token soon falls in
step: where both neighbours put a boundary in their overlap after a character that is not white
space and before white space (no match of the pattern spans such a place, so it is a boundary for
any start), the text is stitched.  The pieces between stitches are encoded in parallel, and their
ids joined in order.  A text with an overlap that holds no such place is encoded as one piece.

Encoding a piece gives the same ids as encoding it inside its text: pieces begin and end at
boundaries, matches depend on what follows only through the look-ahead after white space, and no
piece ends in white space unless the text does.

A run of ``RUN`` white-space characters or more, on which the library's regular expressions fail, is cut out by the
pattern's own rule: such a run is one match, less its last character if text follows, which begins the next match.

Defined cases: a null text counts as empty and has no ids; repeated rows give repeated rows; blank runs may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, map_texts, texts_of

CHUNK = 16_384
OVERLAP = 512

#: White space in every library's reading of the pattern.
_BLANKS = frozenset(" \n\r\t")

RUN = 10_000
#: Runs of what Unicode calls white space, which is what the library takes for it.
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)

_encodings: dict[int, object] = {}


class Tokenizer:
    """A rank file and split pattern, shipped to tasks; the encoder is built once for each worker."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            data = f.read()
        self.pattern = pattern
        self.shared = spark.sparkContext.broadcast(data)
        self.key = hash((hashlib.sha256(data).hexdigest(), pattern))

    def encoding(self):
        import tiktoken

        if self.key not in _encodings:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.shared.value.splitlines())}
            _encodings.clear()
            _encodings[self.key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _encodings[self.key]


def encoded(enc, text: str) -> list[int]:
    """The ids of a text, whatever blank runs it holds."""
    ids, at = [], 0
    for m in _RUN.finditer(text) if len(text) >= RUN else ():
        ids += enc.encode_ordinary(text[at : m.start()])
        at = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc._encode_single_piece(text[m.start() : at].encode())
    return ids + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def boundaries(text: str, pattern: regex.Pattern) -> set[int]:
    """Ends of the pattern's matches after a non-space and before a blank, tab or line end."""
    ends = (m.end() for m in pattern.finditer(text))
    return {b for b in ends if text[b : b + 1] in _BLANKS and not text[b - 1].isspace()}


def split(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks of ``chunk`` code points, each but the last with ``overlap`` more of what follows."""
    return [text[i : i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]


def _pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(rid, doc_id, k, piece): the stitched pieces of long texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rid, ids = part.column("rid").to_pylist(), part.column("doc_id").to_pylist()
                for r, i, text in zip(rid, ids, part.column("text").to_pylist(), strict=True):
                    parts = split(text, chunk, overlap)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r] * len(parts), pa.int64()), pa.array([i] * len(parts), part.column("doc_id").type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                        ["rid", "doc_id", "k", "text"],
                    )

    kind = dict(long.dtypes)["doc_id"]
    chunks = long.mapInArrow(cut, f"rid bigint, doc_id {kind}, k int, text string").repartition("rid", "k")

    def make() -> Callable:
        compiled = regex.compile(pattern)

        def helper(texts: list[str]) -> list:
            ends = [boundaries(t, compiled) for t in texts]
            heads = [sorted(b for b in e if b <= overlap) for e in ends]
            # What lies near the end of a chunk may still change with what follows.
            tails = [sorted(b - chunk for b in e if b >= chunk and b < len(t) - 1) for e, t in zip(ends, texts, strict=True)]
            return [pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))]

        return helper

    marked = map_texts(chunks, make, "heads array<int>, tails array<int>", drop=())
    w = Window.partitionBy("rid").orderBy("k")
    whole = Window.partitionBy("rid")
    cuts = (
        marked.withColumn("next", F.lead("heads").over(w))
        .withColumn("cut", F.when(F.col("next").isNotNull(), F.array_min(F.array_intersect("tails", "next"))))
        .withColumn("from", F.lag("cut").over(w))
        .withColumn("apart", F.bool_and(F.col("next").isNull() | F.col("cut").isNotNull()).over(whole))
    )
    body = F.when(
        F.col("apart"),
        F.expr("substring(text, coalesce(`from`, 0) + 1, if(next is null, length(text), %d + cut) - coalesce(`from`, 0))" % chunk),
    ).otherwise(F.expr("if(next is null, text, substring(text, 1, %d))" % chunk))
    pieces = cuts.select("rid", "doc_id", "k", "apart", body.alias("piece"))
    together = (
        pieces.filter(~F.col("apart"))
        .groupBy("rid")
        .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("parts"))
        .select("rid", "doc_id", F.lit(0).alias("k"), F.array_join("parts.piece", "").alias("piece"))
    )
    apart = pieces.filter("apart").select("rid", "doc_id", "k", "piece")
    return apart.unionByName(together)


def _encoded(df: DataFrame, tokenizer: Tokenizer, text: str) -> DataFrame:
    """``df`` with ids binary (little-endian unsigned 32-bit) in place of its text."""

    def make() -> Callable:
        enc = tokenizer.encoding()
        return lambda texts: [pa.array([packed(encoded(enc, t)) for t in texts], pa.binary())]

    return map_texts(df, make, "ids binary", drop=(text,), text=text)


def _branches(docs: DataFrame, tokenizer: Tokenizer, chunk: int, overlap: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Short texts in place, and long ones as (rid, doc_id, k, ids)."""
    df = texts_of(docs, id_col, text_col)
    big = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    long = df.filter(big).withColumn("rid", F.monotonically_increasing_id())
    return df.filter(~big), _encoded(_pieces(long, tokenizer.pattern, chunk, overlap), tokenizer, "piece")


def _ordered(pieces: DataFrame) -> DataFrame:
    """One row for each long text: its pieces' ids in order (bounded by the text itself)."""
    return pieces.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))


def encode(docs: DataFrame, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) for each document: token ids as little-endian unsigned 32-bit integers."""
    short, pieces = _branches(docs, tokenizer, chunk, overlap, id_col, text_col)
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    return _encoded(short, tokenizer, "text").unionByName(_ordered(pieces).select("doc_id", joined.alias("ids")))


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of each row's ids, concatenated."""
    keep = [c for c in encoded.columns if c != "ids"]
    shape = ", ".join(f"`{n}` {t}" for n, t in encoded.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = tokenizer.encoding().decode_bytes
        for batch in batches:
            raw = [back(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.binary())], [*keep, "bytes"])

    return encoded.mapInArrow(run, f"{shape}, bytes binary")


def op3(docs: DataFrame, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The contract's digests of ids and of decoded bytes, made where the pieces are joined."""
    short, pieces = _branches(docs, tokenizer, chunk, overlap, "doc_id", "text")
    kind = dict(short.dtypes)["doc_id"]
    shape = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def row(parts: list[bytes], back: Callable) -> tuple[int, str, str]:
        ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
        for p in parts:
            n += len(p) // 4
            ids.update(p)
            raw.update(back(np.frombuffer(p, dtype="<u4").tolist()))
        return n, ids.hexdigest(), raw.hexdigest()

    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names)

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer.encoding()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                yield made(part.column("doc_id"), [row([packed(encoded(enc, t or ""))], enc.decode_bytes) for t in texts])

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer.encoding()
        for batch in batches:
            yield made(batch.column("doc_id"), [row([p["ids"] for p in parts], enc.decode_bytes) for parts in batch.column("parts").to_pylist()])

    joined = _ordered(pieces).select("doc_id", "parts").mapInArrow(of_pieces, shape)
    return short.mapInArrow(in_place, shape).unionByName(joined)
