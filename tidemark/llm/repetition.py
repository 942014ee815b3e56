"""Quality rules: how much of a text is repetition.

Texts are cut at white space; each slice's distinct words are numbered and hashed once.  For several n-gram lengths a
polynomial hash rolls over the words (in numpy, all texts of a slice at once); windows of one text with equal hashes are
compared word by word before they count as duplicated.  What is measured is coverage: the characters of words inside
any duplicated window, its first occurrence included, and the characters inside repeated lines.

The verdict: a text is rejected by the base rules (fewer than ``LEAST_WORDS`` words, more than ``REPEATED`` percent of
words inside repeated 5-word windows), or if a coverage is over its limit in ``LIMITS`` or ``LINE_LIMIT``.

Defined cases: null and empty texts have no words and are rejected; blank lines are no lines; repeated rows return once
each; words are runs of anything but the six ASCII white-space characters, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, texts_of

LEAST_WORDS = 10
#: Words of a window of the base rule, and the greatest percentage of words inside repeated ones.
BASE, REPEATED = 5, 20
#: Greatest percentage of word characters inside duplicated n-grams, by n.
LIMITS = {3: 50, 4: 40, 5: 35, 6: 33, 7: 31, 8: 29, 9: 27, 10: 25}
#: Greatest percentage of word characters inside lines that repeat an earlier one.
LINE_LIMIT = 30

SYMBOLS = r"[#*$%&|<>]"
_BLANK = r"[\x20\x09-\x0D]"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash_of(words: list[str]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes (mod 2**64) of windows over values, of any length, by prefix sums."""

    def __init__(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(values), _BASE, np.uint64))))
            # prefix[k] = sum of values[i] * base**i over i < k; a window's part of it is base**start times its own hash.
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.powers[:-1])))

    def windows(self, starts: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[starts + n] - self.prefix[starts]) * self.powers[len(self.powers) - 1 - starts]


def duplicated(ids: np.ndarray, hashes: Rolling, texts: np.ndarray, n: int, shorter: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """For each window of ``n`` words: whether the same words make another window of the same text.

    ``texts`` numbers each word's text; windows across two texts count for neither.  ``shorter`` has a smaller length and
    its marks: a window can only be duplicated if all shorter windows in it are, so no other is hashed again.
    """
    if len(ids) < n:
        return np.zeros(0, bool)
    inside = texts[: len(texts) - n + 1] == texts[n - 1 :]
    if shorter:
        m, marks = shorter
        for k in range(n - m + 1):
            inside &= marks[k : k + len(inside)]
    at = np.flatnonzero(inside)
    if not len(at):
        return inside
    with np.errstate(over="ignore"):
        keys = hashes.windows(at, n) + texts[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys, kind="stable")
    ranked, starts = keys[order], at[order]
    same = ranked[1:] == ranked[:-1]
    a, b = starts[:-1][same], starts[1:][same]
    equal = texts[a] == texts[b]
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    out = np.zeros(len(inside), bool)
    if equal.all():
        out[a] = out[b] = True
        return out
    # Unequal windows with one hash: exact, by the words themselves.
    windows = np.column_stack([texts[at], *(ids[at + k] for k in range(n))])
    _, number, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    out[at] = times[number.ravel()] > 1
    return out


def covered(windows: np.ndarray, words: int, n: int) -> np.ndarray:
    """Which words lie inside a marked window."""
    steps = np.zeros(words + 1, np.int64)
    steps[: len(windows)] += windows
    steps[n : n + len(windows)] -= windows
    return np.cumsum(steps)[:words] > 0


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each row's strings end, and all strings."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets[1:] - offsets[0], lists.flatten()


def measured(texts: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each text: words, word_chars, symbols, dup_lines, dup_line_chars, and for each n-gram length the words
    (``words_n``) and characters (``chars_n``) inside duplicated n-grams."""
    texts = texts.fill_null("")
    ends, words = _parts(pc.ascii_split_whitespace(texts))
    numbered = words.dictionary_encode()
    values, ids = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
    sizes = pc.utf8_length(values).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    real = sizes[ids] > 0 if len(ids) else np.zeros(0, bool)  # white space at either end leaves an empty word
    ends, ids, text = _sums(real, ends).cumsum(), ids[real], text[real]
    chars, hashes = sizes[ids], _hash_of(values.to_pylist())[ids]
    out = {
        "words": np.diff(ends, prepend=0),
        "word_chars": _sums(chars, ends),
        "symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
    }
    hashes, shorter = Rolling(hashes), None
    for n in sorted(lengths):
        marks = duplicated(ids, hashes, text, n, shorter)
        shorter = n, marks
        inside = covered(marks, len(ids), n)
        out[f"words_{n}"], out[f"chars_{n}"] = _sums(inside, ends), _sums(inside * chars, ends)

    line_ends, lines = _parts(pc.split_pattern(texts, "\n"))
    numbered = lines.dictionary_encode()
    own = np.repeat(np.arange(len(texts)), np.diff(line_ends, prepend=0)) * max(1, len(numbered.dictionary)) + numbered.indices.to_numpy()
    again = np.ones(len(own), bool)
    again[np.unique(own, return_index=True)[1]] = False
    inked = pc.utf8_length(pc.replace_substring_regex(numbered.dictionary, _BLANK, "")).to_numpy().astype(np.int64)[numbered.indices.to_numpy()]
    out["dup_lines"], out["dup_line_chars"] = _sums(again & (inked > 0), line_ends), _sums(again * inked, line_ends)
    return out


def scores(docs: DataFrame, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, dup_chars map<int, bigint>, base_failed, kept)
    of each document, in one pass and without a shuffle."""
    limits = LIMITS if limits is None else limits
    df = texts_of(docs, id_col, text_col)
    lengths = tuple(sorted({BASE, *limits}))
    plain = ("words", "word_chars", "symbols", "dup_lines", f"words_{BASE}", "dup_line_chars")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                got = measured(part.column("text"), lengths)
                failed = (got["words"] < LEAST_WORDS) | (100 * got[f"words_{BASE}"] > REPEATED * got["words"])
                kept = ~failed & (100 * got["dup_line_chars"] <= line_limit * got["word_chars"])
                for n, most in limits.items():
                    kept &= 100 * got[f"chars_{n}"] <= most * got["word_chars"]
                each = np.column_stack([got[f"chars_{n}"] for n in lengths]).ravel()
                maps = pa.MapArray.from_arrays(pa.array(np.arange(0, len(each) + 1, len(lengths)), pa.int32()), pa.array(np.tile(lengths, part.num_rows), pa.int32()), pa.array(each))
                arrays = [part.column("doc_id"), *(pa.array(got[c]) for c in plain), maps, pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "dup_chars", "base_failed", "kept"])

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} bigint' for n in names)}, dup_chars map<int, bigint>, base_failed boolean, kept boolean")


def reject(docs: DataFrame, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; no join, the verdict is made where the row stands."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    judged = scores(docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text")), limits, line_limit, "row", "text")
    return judged.filter("kept").select("doc_id.*")


def op12(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the characters inside duplicated n-grams and lines behind the verdict."""
    got = scores(docs)
    plain = [c for c in got.columns if c != "dup_chars"]
    return got.select(*plain, *(F.col("dup_chars")[n].alias(f"dup_chars_{n}") for n in sorted(LIMITS)))
