"""Structure repair, repetition rules and cross-tokenizer alignment against brute-force versions, and on odd inputs."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from small import MEDIUM, SMALL
from tokenizers import Tokenizer

from tidemark.llm import crosstok, lzprint, repetition, turnrepair
from tidemark.llm.common import shard_bounds, table

WHITE = "\x20\x09-\x0d"


# Shards


def test_shards_grow_in_size_where_their_number_is_bounded(spark):
    df = spark.range(1_000).toDF("doc_id")
    bounds, counts = shard_bounds(df, "doc_id", 10, most=7)
    assert len(bounds) == 6 and counts["rows"] == 1_000 and len(shard_bounds(df, "doc_id", 10)[0]) == 99
    docs = spark.createDataFrame([(k, f"text {k} " * 9) for k in range(50)], "doc_id long, text string")
    assert sorted(map(tuple, lzprint.op5(docs, 7).collect())) == sorted(map(tuple, lzprint.op5(docs, 1_000).collect()))


# Structure repair


def cheapest(initials, states):
    """(cost, audit) by recursion over the grammar's automaton: 0 start, 1 after the system turn, 2 wants a, 3 wants u."""

    @functools.cache
    def go(i, q, inserted):
        found = [(0, "")] if i == len(states) and q in (0, 3) else []

        def take(cost, letter, rest):
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1]))

        after = 3 if q == 2 else 2
        if i < len(states):
            take(4, "D", go(i + 1, q, 0))
            if states[i] != "x":
                extra = 3 * (states[i] == "t")
                if q == 0 and initials[i] == "s":
                    take(extra, "K", go(i + 1, 1, 0))
                if initials[i] == ("a" if q == 2 else "u"):
                    take(extra, "K", go(i + 1, after, 0))
                take(3 + extra, "R", go(i + 1, after, 0))
        if inserted < 3:
            take(3, "I", go(i, after, inserted + 1))
        return min(found, default=None)

    return go(0, 0, 0)


def test_alignment_equals_recursion():
    r = random.Random(11)
    for _ in range(2_000):
        n = r.randint(0, 9)
        initials, states = [r.choice("ssuuuaa?") for _ in range(n)], [r.choice("kkkktx") for _ in range(n)]
        assert turnrepair.aligned(initials, states) == cheapest(tuple(initials), tuple(states))
    for n in (60, 200):
        initials = ["ua"[k % 2] if r.random() > 0.2 else r.choice("us") for k in range(n)]
        states = [r.choice("kkkkkkkxt") for _ in range(n)]
        assert turnrepair.aligned(initials, states) == cheapest(tuple(initials), tuple(states))


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        own += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def repaired_by_hand(rows):
    out = []
    for conv, turns in damaged_by_hand(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        seen, states, counts = set(), [], Counter()
        for _, role, text in turns:
            inked = re.findall(f"[^{WHITE}]", text)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            states.append("x" if fault in ("blank", "duplicate") else "t" if fault else "k")
        initials = [role[:1] for _, role, _ in turns]
        cost, audit = cheapest(tuple(initials), tuple(states))
        kept, at = [], 0
        for e in audit:
            if e == "I":
                kept.append([e, None, ""])
            else:
                if e != "D":
                    kept.append([e, *turns[at][1:]])
                at += 1
        user = True
        for k, x in enumerate(kept):
            if k == 0 and x[0] == "K" and x[1][:1] == "s":
                continue
            if x[0] != "K":
                x[1] = "user" if user else "assistant"
            user = not user
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in kept).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_query_equals_brute_force(spark):
    given = table(spark, MEDIUM, "conversations")
    got = turnrepair.op11(given)
    assert tuple(got.columns) == COLUMNS
    mine = sorted((tuple(r) for r in got.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert mine == repaired_by_hand([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given.collect()])


def test_repair_of_odd_conversations(spark):
    r = random.Random(4)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (7, None, "assistant", "Yes."), (7, None, "user", "Ok?")]
    rows += [(c, r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["A.", "b", "", None, " \n", "é! ", "x" * 5_000])) for c in range(40) for _ in range(r.randint(1, 12))]
    given = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, gone string, phase int")
    mine = sorted((tuple(x) for x in turnrepair.op11(given).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert mine == repaired_by_hand(rows)
    assert turnrepair.op11(given.limit(0)).collect() == []


def test_conversation_without_turns_is_empty(spark):
    lone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = turnrepair.op11(spark.createDataFrame([(lone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (lone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_keep_texts_and_spell_the_grammar(spark):
    given = table(spark, SMALL, "conversations")
    by = defaultdict(list)
    for x in turnrepair.repaired(given).collect():
        by[x["conv_id"]].append((x["place"], x["edit"], x["role"], x["text"]))
    known = {x["text"] for x in given.collect()} | {""}
    for turns in by.values():
        turns.sort()
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[2][0] for t in turns))
        assert all(t[3] in known and (t[1] != "I" or t[3] == "") for t in turns)


# Repetition


def repetition_by_hand(text, lengths):
    text = text or ""
    words = re.findall(f"[^{WHITE}]+", text)
    out = {"words": len(words), "word_chars": sum(map(len, words)), "symbols": sum(c in "#*$%&|<>" for c in text)}
    for n in lengths:
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        met, inside = Counter(windows), [False] * len(words)
        for i, w in enumerate(windows):
            if met[w] > 1:
                inside[i : i + n] = [True] * n
        out |= {f"words_{n}": sum(inside), f"chars_{n}": sum(len(w) for w, x in zip(words, inside, strict=True) if x)}
    seen, again = set(), []
    for line in text.split("\n"):
        inked = re.sub(f"[{WHITE}]", "", line)
        if inked and line in seen:
            again.append(len(inked))
        seen.add(line)
    return out | {"dup_lines": len(again), "dup_line_chars": sum(again)}


def random_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab é\n\x0b<\x85") if r.random() < 0.5 else r.choice([" a", " b", "\na b"]) for _ in range(r.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("collide", [False, True])
def test_coverage_equals_brute_force(collide, monkeypatch):
    if collide:  # every word hashes alike: the words themselves decide
        monkeypatch.setattr(repetition, "_hash_of", lambda words: np.zeros(len(words), np.uint64))
    given, lengths = [*random_texts(3, 300), None, "", " a"], (2, 3, 5, 7)
    got = repetition.measured(pa.array(given), lengths)
    for k, text in enumerate(given):
        by_hand = repetition_by_hand(text, lengths)
        assert {c: int(v[k]) for c, v in got.items()} == by_hand


def test_repetition_query_equals_brute_force(spark, odd_docs, no_docs):
    docs = table(spark, MEDIUM, "documents")
    lengths = (5, *repetition.LIMITS)
    for given in (docs, odd_docs):
        by_id = defaultdict(list)
        for r in given.collect():
            x = repetition_by_hand(r["text"], lengths)
            failed = x["words"] < 10 or 100 * x["words_5"] > 20 * x["words"]
            over = any(100 * x[f"chars_{n}"] > most * x["word_chars"] for n, most in repetition.LIMITS.items()) or 100 * x["dup_line_chars"] > repetition.LINE_LIMIT * x["word_chars"]
            by_id[r["doc_id"]].append((x["words"], x["word_chars"], x["symbols"], x["dup_lines"], x["words_5"], failed, not failed and not over))
        got = defaultdict(list)
        for r in repetition.op12(given).collect():
            got[r["doc_id"]].append(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_id.items()}
    assert repetition.op12(no_docs).collect() == []
    kept = repetition.reject(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1]


def test_good_documents_are_kept(spark):
    good = {r["doc_id"] for r in table(spark, MEDIUM, "labels").filter("quality = 1").collect()}
    rows = [r for r in repetition.op12(table(spark, MEDIUM, "documents")).collect() if r["doc_id"] in good]
    assert all(r["kept"] for r in rows if not r["base_failed"])


# Cross-tokenizer alignment


A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def toks(spark):
    return crosstok.Tokenizers(spark, A, B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_by_hand(text, libraries):
    a, b = libraries
    if not text:
        return None
    letters = crosstok.byte_letters()
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == raw == b"".join(bytes_b) else None


def aligned_by_hand(text, libraries):
    """(groups, links) from byte ranges alone."""
    got = tokens_by_hand(text, libraries)
    if got is None:
        return None
    ids_a, bytes_a, ids_b, bytes_b = got
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    spans_a, spans_b = list(zip([0, *ends_a], ends_a, strict=False)), list(zip([0, *ends_b], ends_b, strict=False))
    links = [(x, y) for x, (s, e) in zip(ids_a, spans_a, strict=True) for y, (f, g) in zip(ids_b, spans_b, strict=True) if s < g and f < e]
    groups, last = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        inside = [[str(i) for i, end in zip(ids, ends, strict=True) if last < end <= cut] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
        groups.append("|".join(",".join(x) for x in inside))
        last = cut
    return len(ids_a), len(ids_b), groups, links


STRANGE = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "it's we'll\n\n  x\t y", "▁a b", "<s> </s> <unk> <|endoftext|> <0x41>", "\u0000 \x1c \x85 \xa0   x",
    "日本語のテキスト 漢字", "\U0001f600\U0001f469‍\U0001f680 é", "x" * 3_000, " " * 3_000 + "y", "a\r\n b᠎ c", "ẞß ǅ Ⅷ ½ ²", "1234567 89.50 -- == !!",
]


def test_segments_encode_as_whole_texts_do(toks, libraries):
    r = random.Random(8)
    bits = ["the ", "日 ", "\u2003 ", "\u200d ", "! ", " 's", "ab", "\n", " ", "  ", "é", "▁", "日", "\U0001f600", "12", "<s>", "\xa0", " ", "x\t", "q. ", "͸", "\x00", "﻿", "\x1f "]
    for text in [*STRANGE, *("".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(2_000))]:
        whole = tokens_by_hand(text, libraries)
        _, found, numbers, filled = crosstok._numbered(pa.array([text], pa.string()))
        assert "".join(found[k] for k in numbers) == " " + (text or "") and filled[0] == bool(text)
        for cut in ([found[k] for k in numbers], crosstok.segments(text or "")):
            parts = [toks.pair().encoded(s) for s in cut] if text else [None]
            mine = None if None in parts else (sum((p[0] for p in parts), []), sum((p[1] for p in parts), []))
            assert mine == (whole and (whole[0], whole[2])), repr(text)


def test_perfect_hash_numbers_every_key_once():
    keys = np.random.default_rng(1).choice(1 << 40, 50_000, replace=False).astype(np.uint64)
    for own in (keys, keys[:1], keys[:0]):
        levels = crosstok.PerfectHash.levels(own)
        h = crosstok.PerfectHash(levels)
        assert h.n == len(own) and sorted(h.number(own).tolist()) == list(range(len(own)))
    assert 8 * sum(map(len, crosstok.PerfectHash.levels(keys))) < 5 * len(keys)
    others = np.arange(1 << 41, (1 << 41) + 1_000, dtype=np.uint64)
    assert crosstok.PerfectHash(crosstok.PerfectHash.levels(keys)).number(others).max() < len(keys)


def expected(texts, libraries):
    found = {t: aligned_by_hand(t, libraries) for t in set(texts)}
    count = Counter(link for t in texts if found[t] for link in found[t][3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)

    def row(text):
        got = found[text]
        if got is None:
            return 0, 0, 0, 0, 0, 0, ""
        n_a, n_b, groups, links = got
        return n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()

    return row, count


@pytest.mark.parametrize("block", [1, crosstok.BLOCK_PAIRS])
def test_alignment_query_equals_brute_force(spark, toks, libraries, block, monkeypatch):
    monkeypatch.setattr(crosstok, "FAN", 2)
    texts = [*STRANGE, "a  b   c", *(r["text"][:1_500] for r in table(spark, SMALL, "documents").limit(60).collect())]
    row, count = expected(texts, libraries)
    given = spark.createDataFrame([(k // 2, t, k) for k, t in enumerate(texts)], "doc_id long, text string, groups long").repartition(7)
    monkeypatch.setattr(crosstok.align, "__defaults__", (block, *crosstok.align.__defaults__[1:]))
    got = crosstok.op13(given, toks)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((k // 2, *row(t)) for k, t in enumerate(texts))
    if block > 1:
        pairs = {(r["a_id"], r["b_id"]): r["n"] for r in crosstok.pair_counts(given, toks).collect()}
        assert pairs == dict(count)


def test_alignment_of_odd_documents(spark, toks, libraries, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    short = [(i, t if t is None else t[:400]) for i, t in rows]
    row, _ = expected([t for _, t in short], libraries)
    got = crosstok.op13(spark.createDataFrame(short, "doc_id long, text string"), toks).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *row(t)) for i, t in short), key=key)
    assert crosstok.op13(odd_docs, toks).count() == len(rows)
    assert crosstok.op13(no_docs, toks).collect() == []


def test_sums_of_a_bucket_are_made_in_slices(monkeypatch):
    from collections import Counter

    import numpy as np

    from tidemark.llm import ngramlm

    rng = np.random.default_rng(5)
    hashes = [np.unique(rng.integers(0, 900, n, dtype=np.uint64) + np.uint64((1 << 64) - 1000)) for n in (400, 1, 700, 0, 50)]
    counts = [rng.integers(0, 4, len(h)).astype(np.uint32) for h in hashes]
    total = Counter()
    for h, c in zip(hashes, counts, strict=True):
        total.update(dict(zip(h.tolist(), c.tolist(), strict=True)))
    asks = [True, True, True, True, False]
    seen, unique = [], np.unique
    monkeypatch.setattr(ngramlm.np, "unique", lambda x, **k: seen.append(len(x)) or unique(x, **k))
    for size in (64, 1 << 18):
        monkeypatch.setattr(ngramlm, "SLICE_GRAMS", size)
        seen.clear()
        got = ngramlm.outside_counts(hashes, counts, asks)
        assert max(seen) <= 3 * size
        for h, c, asking, (at, x) in zip(hashes, counts, asks, got, strict=True):
            want = [(k, total[v] - n) for k, (v, n) in enumerate(zip(h.tolist(), c.tolist(), strict=True)) if total[v] > n and asking]
            assert list(zip(at.tolist(), x.tolist(), strict=True)) == want
    assert [len(at) for at, _ in ngramlm.outside_counts([hashes[3]], [counts[3]], [True])] == [0]


def test_rows_of_megabytes_are_written_in_groups_of_few(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tidemark.llm import ngramlm

    monkeypatch.setattr(ngramlm, "ROW_GROUP", 1 << 20)
    tables = ngramlm._Tables(spark)
    try:
        df = spark.range(0, 12, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("s")).withColumn("s", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.sha2(F.concat("s", i.cast("string")), 512))))
        assert tables.write(df).count() == 12
        files = glob.glob(f"{tables.paths[0].removeprefix('file:')}/*.parquet")
        # Half a megabyte a row: by default all twelve were held until the file was closed.
        assert len(files) == 1 and pq.ParquetFile(files[0]).num_row_groups >= 3
    finally:
        tables.remove()
