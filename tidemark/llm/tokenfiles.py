"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent, ties by id), so frequent ids take
one byte.  Four ranks share a control byte that holds four lengths (2 bits each, length less one);
the ranks' bytes (little-endian) follow in a stream of their own.  A file is a Parquet folder:
``blocks`` holds rows (shard, block, start, doc_ids, sizes, control, data) in ascending id order
and ``ranks`` holds (rank, id).  Reading looks each control byte up in a 256-row numpy table for its
lengths, and gathers the bytes of a block at once.

Texts are encoded at white space, where the tokenizer separates words anyway; each worker keeps a
bounded memo of words.  Raw ids are staged once, with each task's counts of them, so that ranks are
known before anything is written; the staged ids are deleted when the file stands.  Every shard of
consecutive ids is a partition of its own.

Defined cases: a null text counts as empty and gives the end id alone; rows with equal ids follow
each other in the order of their ids' bytes; null ids come first; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, remove, shard_bounds, shard_of, shared_dir, texts_of

END_ID = 2
SHARD_ROWS = 4096
BLOCK_TOKENS = 1 << 20
MEMO = 300_000
#: Text bytes whose words are numbered together.
ENCODED_BYTES = 8 << 20

#: For each control byte: the lengths of its four codes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1

_tokenizers: dict[int, object] = {}


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2**32."""
    r = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint32)
    r[: len(ranks)] = ranks
    size = 1 + (r > 0xFF) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = (size - 1).reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8)
    raw = r.view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ranks of ``pack``'s bytes."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()
    end = np.cumsum(size)
    at = end - size
    raw = np.concatenate((np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)))
    out = np.zeros(len(size), dtype=np.uint32)
    for k in range(4):
        out |= np.where(size > k, raw[np.minimum(at + k, len(raw) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
    return out[:n]


def _byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others take the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


#: Words of these characters alone are cut into pre-tokens here: ASCII but "<", which opens special tokens, and the
#: letters below U+0250 but U+0130, whose normal form and lower case are made one by one.
_PLAIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Fixed value: the tokenizer's own split of a lower-case word, for those characters.
_PRETOKEN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u024f0-9]+")


class Words:
    """Ids of the words of a text, by a tokenizer shipped as its file's bytes."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.key = hash(path)

    def encoder(self) -> Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]:
        """A function from texts and the end id to all ids, and to where each text's ids end.

        A batch's words are numbered first, so that each distinct word is looked up once and the ids of all
        words are gathered by number.  A word of plain characters (see ``_PLAIN``) is cut into pre-tokens
        here and each of those goes straight to the BPE model; every other word goes through the whole tokenizer.
        """
        if self.key not in _tokenizers:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core is all it has
            from tokenizers import Tokenizer

            _tokenizers.clear()
            _tokenizers[self.key] = (Tokenizer.from_str(self.shared.value.decode()), [{}, {}])
        tokenizer, memo = _tokenizers[self.key]
        tokenize = tokenizer.model.tokenize

        def ids_of(word: str) -> bytes | None:
            """A known word's ids, those of a plain word's pre-tokens, or None."""
            ids = memo[1].get(word)
            if ids is not None:
                memo[0][word] = ids
                return ids
            low = word.lower()
            if low.isalpha() and low.isascii():
                parts = [low]
            elif _PLAIN.fullmatch(word) and _PLAIN.fullmatch(low):
                parts = _PRETOKEN.findall(low)
            else:
                return None
            if parts == [word]:
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = array("H", [t.id for t in tokenize(letters)]).tobytes()
            else:  # a pre-token alone is its own only pre-token
                young = memo[0]
                ids = b"".join([young.get(p) or ids_of(p) for p in parts])
            memo[0][word] = ids
            return ids

        def looked_up(found: list[str]) -> list[bytes]:
            if len(memo[0]) > MEMO:  # the younger half becomes the older one, which only gives
                memo[:] = [{}, memo[0]]
            out = list(map(memo[0].get, found))
            for k in [k for k, ids in enumerate(out) if ids is None]:
                out[k] = ids_of(found[k])
            other = [k for k, ids in enumerate(out) if ids is None]
            for k, e in zip(other, tokenizer.encode_batch_fast([found[k] for k in other], add_special_tokens=False), strict=True):
                out[k] = memo[0][found[k]] = array("H", e.ids).tobytes()
            return out

        def encode(texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
            # A stop or comma between a letter and white space is a pre-token of its own.
            marked = pa.compute.replace_substring_regex(texts.fill_null(""), r"([A-Za-z])([.,])(\s|$)", r"\1 \2\3")
            split = pa.compute.ascii_split_whitespace(marked)
            at = split.offsets.to_numpy()
            numbered = split.flatten().dictionary_encode()
            each = pa.array([*looked_up(numbered.dictionary.to_pylist()), array("H", [end_id]).tobytes()], pa.binary())
            # The end id stands after the words of each text.
            gathered = each.take(pa.array(np.insert(numbered.indices.to_numpy(), at[1:] - at[0], len(each) - 1)))
            _, offsets, data = gathered.buffers()
            ends = np.frombuffer(offsets, dtype=np.int32, count=len(gathered) + 1)[1 + at[1:] - at[0] + np.arange(len(at) - 1)] // 2
            return np.frombuffer(data, dtype="<u2", count=int(ends[-1]) if len(ends) else 0), ends

        return encode


def _encoded(docs: DataFrame, words: Words, end_id: int, id_col: str, text_col: str, counted: bool, vocabulary: int = 1 << 16) -> DataFrame:
    """(doc_id, ids, counts): 16-bit ids of each whole text and the end id; ``counted``: at the end of each task one
    row more, without an id, with how often the task met each id."""
    df = texts_of(docs, id_col, text_col)
    kind = dict(df.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, id_type = words.encoder(), np.zeros(vocabulary, dtype=np.int64), None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in byte_slices(batch, "text", ENCODED_BYTES):
                ids, ends = encode(part.column("text"), end_id)
                if counted:
                    seen += np.bincount(ids, minlength=vocabulary)
                offsets = np.concatenate(([0], 2 * ends)).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.nulls(part.num_rows, pa.binary())], ["doc_id", "ids", "counts"])
        if counted and id_type is not None:
            last = [pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, ["doc_id", "ids", "counts"])

    return df.mapInArrow(run, f"doc_id {kind}, ids binary, counts binary")


def encoded(docs: DataFrame, words: Words, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): 16-bit ids of each whole text and the end id."""
    return _encoded(docs, words, end_id, id_col, text_col, False).select("doc_id", "ids")


def frequency_ranks(staged: DataFrame) -> DataFrame:
    """(id, n) of every id in use, from the counts that each task left; one row for a task and an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                n = n + np.frombuffer(x, dtype=np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used] if len(used) else [], pa.int64())], ["id", "n"])

    return staged.filter("counts is not null").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, words: Words, end_id: int = END_ID, rows: int = SHARD_ROWS, block: int = BLOCK_TOKENS) -> None:
    """Write the documents' ids to ``path`` in ascending id order."""
    spark = docs.sparkSession
    staged_path = shared_dir(spark)
    _encoded(docs, words, end_id, "doc_id", "text", True).write.option("compression", "zstd").parquet(staged_path)
    # At most 2**16 rows, by the type of an id.
    order = [r["id"] for r in frequency_ranks(spark.read.parquet(staged_path)).orderBy(F.desc("n"), "id").collect()]
    staged = spark.read.parquet(staged_path).filter("ids is not null").select("doc_id", "ids")
    rank = np.zeros(1 << 16, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    bounds, _ = shard_bounds(staged, "doc_id", rows)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, held, shard, number, start = shared.value, [], None, 0, 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(x, dtype="<u2") for _, x in held])
            control, data = pack(rank[ids])
            row = [shard, number, start, [i for i, _ in held], [len(x) // 2 for _, x in held], control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow, strict=True)], columns)

        arrow = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        size = 0
        for batch in batches:
            for s, i, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if held and (s != shard or size + len(x) // 2 > block):
                    yield made()
                    number, start, held, size = (number + 1, start + size, [], 0) if s == shard else (0, 0, [], 0)
                shard = s
                held.append((i, x))
                size += len(x) // 2
        if held:
            yield made()

    columns = ["shard", "block", "start", "doc_ids", "sizes", "control", "data"]
    ddl = "shard int, block int, start bigint, doc_ids array<bigint>, sizes array<bigint>, control binary, data binary"
    (
        staged.withColumn("shard", shard_of(bounds)("doc_id"))
        .repartitionById(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(shape, ddl)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    remove(spark, staged_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary little-endian unsigned 32-bit) for each document of a file."""
    return _per_document(spark, path, "ids binary", lambda ids: [pa.array([x.tobytes() for x in ids], pa.binary())])


def _per_document(spark: SparkSession, path: str, added: str, make: Callable[[list[np.ndarray]], list]) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    table = np.zeros(max((r["rank"] for r in ranks), default=0) + 1, dtype="<u4")
    table[[r["rank"] for r in ranks]] = [r["id"] for r in ranks]
    # One total for each shard; their number is bounded when the file is written.
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    totals = blocks.groupBy("shard").agg(F.sum(total).alias("n")).orderBy("shard").collect()
    first = dict(zip([r["shard"] for r in totals], np.cumsum([0, *(r["n"] for r in totals)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((table, first))
    names = ["doc_id", "start", "n_tokens", *(a.split()[0] for a in added.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                ids = table[unpack(row["control"], row["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                starts = first[row["shard"]] + row["start"] + ends - sizes
                each = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), *make(each)], names)

    return blocks.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {added}")


def op10(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's columns, from the file read back."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write(docs, path, Words(spark, tokenizer_path))
    return _per_document(spark, path, "ids_crc32 bigint", lambda ids: [pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())])
