"""Each operator against a brute-force version, and on odd inputs."""

import base64
import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from small import MEDIUM, SMALL
from tokenizers import Tokenizer

from tidemark.llm import bpe, cotrain, decontam, htmltext, lzprint, ngramlm, pii, simhash, tokenfiles, toxicity
from tidemark.llm.common import table


def rows(df, *keys):
    got = [tuple(r) for r in df.select(*keys).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))


def texts(spark, sf=SMALL):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


# Decontamination


def spans_by_hand(text, wins):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit = set()
    for w in wins:
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                hit |= set(range(i, i + len(w)))
    return len(words), len(hit)


@pytest.mark.parametrize("block", [7, 10_000])
def test_scan_equals_brute_force(spark, odd_docs, block):
    bench = spark.createDataFrame(
        [(1, "Three four five six seven eight NINE ten eleven twelve thirteen"), (2, "two three"), (3, None), (None, "gamma"), (5, "!")],
        "item_id long, text string",
    )
    wins = [["two", "three"], ["gamma"]]
    got = decontam.scan(odd_docs, bench, block_windows=block)
    by_hand = sorted((*spans_by_hand(r["text"], wins), r["doc_id"] or -1) for r in odd_docs.collect())
    found = sorted((r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["doc_id"] or -1) for r in got.collect())
    assert found == by_hand
    assert {tuple(r["items"]) for r in got.collect()} == {(), ("2",)}


def test_decontaminate_cuts_spans_and_keeps_clean_documents(spark, odd_docs):
    bench = spark.createDataFrame([(1, "four five six seven eight nine ten eleven")], "item_id long, text string")
    kept = decontam.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert [r["text"] for r in kept.filter("doc_id = 1").collect()] == ["one two three"] * 2
    assert kept.count() == odd_docs.count()
    assert decontam.decontaminate(odd_docs, bench, mode="documents").filter("doc_id = 1").isEmpty()
    gone = spark.createDataFrame([(9, "Four, five six seven eight nine ten eleven!")], "doc_id long, text string")
    assert decontam.decontaminate(gone, bench).isEmpty()


def test_decontaminate_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = decontam.op2(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"))
    want = con.execute(decontam.SQL).df()
    assert rows(got, *want.columns) == sorted(map(tuple, want.values.tolist()))
    assert got.filter("contaminated").count() > 0


def test_blocks_of_two_benchmarks_never_share_an_index(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    benches = [spark.createDataFrame([(1, t)], "item_id long, text string") for t in ("one two", "three four")]
    # As if both frames of windows had the same address.
    monkeypatch.setattr(decontam, "id", lambda _: 1, raising=False)
    keys = [b.value[0] for x in benches for b in decontam._blocks(docs, x, 10, 1)]
    assert len(set(keys)) == len(keys) == 2
    assert [decontam.decontaminate(docs, x).first()["text"] for x in benches] == ["three four", "one two"]


# Byte-level BPE


def tokenizer(spark):
    return bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def whole_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (100, 40), (37, 12)])
def test_bpe_equals_the_library_on_whole_texts(spark, odd_docs, chunk, overlap):
    enc = whole_encoding()
    tricky = spark.createDataFrame(
        [(20, "it's   we'll \x1c!!\x1c  x y   z'" * 40), (21, "a" * 333 + " " * 333 + "b"), (22, "12 34\r\n\r\n" * 99)], "doc_id long, text string"
    )
    docs = odd_docs.select("doc_id", "text").unionByName(tricky).unionByName(table(spark, SMALL, "documents").select("doc_id", "text").filter("doc_id >= 100"))

    def row(i, t):
        ids = enc.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    want = sorted((row(r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: tuple((x is not None, x) for x in r))
    got = bpe.op3(docs, tokenizer(spark), chunk, overlap)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_of_long_blank_runs(spark):
    enc = whole_encoding()
    for run in (" " * 10_000, " " * 30_001, "\n \t" * 4_000, "\u3000" * 12_000, "\x85" * 10_001):
        for text in (f"a{run}b", f"a{run}", f"{run}b", run, f"a{run}'s {run}!", f"x {run}\x1c{run}y"):
            assert bpe.encoded(enc, text) == enc.encode_ordinary(text)
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_500_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in bpe.op3(docs, tokenizer(spark)).collect()}
    sizes = {1: 1_000_001, 2: 1_500_000}  # a blank each, but the last one before the letter, which it is part of
    assert got == {r["doc_id"]: (sizes[r["doc_id"]], hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect()}


def test_bpe_round_trip(spark, odd_docs, no_docs):
    t = tokenizer(spark)
    back = bpe.decode(bpe.encode(odd_docs, t, 1000, 50), t)
    want = sorted(((r["doc_id"] or -1), (r["text"] or "").encode()) for r in odd_docs.collect())
    assert sorted(((r["doc_id"] or -1), bytes(r["bytes"])) for r in back.collect()) == want
    assert bpe.encode(no_docs, t).isEmpty() and bpe.op3(no_docs, t).isEmpty()


# Toxicity


def test_toxicity_held_out_accuracy(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    got = toxicity.op4(docs, labels)
    assert got.count() == docs.count()
    scored = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert ((scored.predicted == 1) == (scored.toxic == 1)).mean() >= 0.97
    assert scored.predicted[scored.toxic == 1].mean() >= 0.8 and scored.predicted[scored.toxic == 0].mean() <= 0.02
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())


def test_toxicity_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (99, 0)], "doc_id long, toxic int")
    got = toxicity.op4(odd_docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.op4(no_docs, labels).isEmpty()
    none = labels.filter("false")
    assert {r["score"] for r in toxicity.op4(odd_docs, none).collect()} == {0.0}
    assert toxicity.reject_toxic(odd_docs, none).count() == 10


# Phrase fingerprints


def test_lz_fingerprints_equal_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(table(spark, SMALL, "documents").select("doc_id", "text").filter("doc_id >= 150"))
    got = rows(lzprint.op5(docs, rows=9), "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (lzprint.signature(x) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lzprint.likeness(a, b), lzprint.likeness(a, c)))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def signature_by_hand(text):
    """The parse and the minimum hashes once more, from their definition alone."""
    book, i = [], 0
    while i < len(text):
        n = 1
        while text[i : i + n] in book and i + n < len(text):
            n += 1
        if text[i : i + n] not in book:
            book.append(text[i : i + n])
        i += n
    out = ["ffffffff"] * lzprint.BINS
    for phrase in book:
        h = xxhash.xxh64_intdigest(phrase.encode())
        low = f"{min(h % 2**32, 2**32 - 2):08x}"
        out[h // 2**57] = min(out[h // 2**57], low)
    return "".join(out)


def test_lz_fingerprints_follow_their_definition(spark):
    own = [t[:1500] for t in texts(spark).values()][:40] + ["", "a", "aa", "aaa", "abababab", "\u00e9\U0001f600" * 9]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lzprint.op5(docs).collect()}
    for i, t in enumerate(own):
        after = own[(i + 1) % len(own)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want = [signature_by_hand(x) for x in (t, edited, after)]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (want[0], want[1])
        for name, other in (("near_edited", want[1]), ("near_next", want[2])):
            bins = [(want[0][k : k + 8], other[k : k + 8]) for k in range(0, len(want[0]), 8)]
            filled = [a == b for a, b in bins if (a, b) != ("ffffffff", "ffffffff")]
            assert got[i][name] == pytest.approx(sum(filled) / len(filled) if filled else 1.0)


def test_lz_likeness_estimates_phrase_overlap(spark, no_docs):
    assert lzprint.phrases("aababcabcd") == {"a", "ab", "abc", "abcd"}
    own = list(texts(spark).values())[:60]
    for a, b in zip(own, own[1:], strict=False):
        mixed = a[: len(a) // 2] + b
        p, q = lzprint.phrases(a), lzprint.phrases(mixed)
        if len(p | q) > 100:
            assert abs(lzprint.likeness(lzprint.signature(a), lzprint.signature(mixed)) - len(p & q) / len(p | q)) < 0.25
    assert lzprint.likeness(lzprint.signature(""), lzprint.signature("")) == 1.0
    assert lzprint.op5(no_docs).isEmpty()
    one = spark.createDataFrame([(3, "only")], "doc_id long, text string")
    assert rows(lzprint.op5(one), "near_edited", "near_next") == [(lzprint.likeness(lzprint.signature("only"), lzprint.signature("onon")), 1.0)]
    same = lzprint.fingerprints(one).join(lzprint.fingerprints(one).toDF("doc_id", "other"), "doc_id")
    assert lzprint.compare(same, "fingerprint", "other").first()["likeness"] == 1.0


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    def luhn(n):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(n[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


ODD = [
    "a@b.c@d.e x@@y.z @a.b a@b a.b-c@d-e.f.g. 1@2.3",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 1.2.3 001.02.3.255 1.2.3.999.4.5.6.7",
    "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 41111111111111111111 4 1-1",
    "+1 (212) 555-0100 ++12345678 +1.2.3.4.5.6.7.8 +49--- +123",
    "card 3782 822463 10005, IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432X",
]


def test_pii_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("a1@.+- ()2.,4é"), 60)) for _ in range(400)]
    for text in [*ODD, *noise, *texts(spark).values()]:
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == base_by_hand(text), text


def test_pii_added_spans_and_context():
    found = {s[0]: s for s in pii.find(ODD[4])}
    assert ODD[4][slice(*found["iban"][1:3])] == "DE89 3704 0044 0532 0130 00" and found["card_short"][3] >= pii.KEEP
    assert not pii.find("number 3782 822463 10005") and not pii.find("DE88 3704 0044 0532 0130 00")
    assert pii.find("a" * 200_000) == [] and pii.find("1" * 200_000) == [] and pii.find("1." * 100_000)


def test_pii_context_counts_whole_words_in_both_directions():
    iban, short = "DE89 3704 0044 0532 0130 00", "3782 822463 10005"
    kinds = lambda text: [s[0] for s in pii.find(text) if s[0] not in pii.BASE]
    assert kinds(iban) == ["iban"] and kinds(f"serial {iban}") == [] and kinds(f"bank order {iban}") == ["iban"]
    assert kinds(f"card {short}") == ["card_short"] and kinds(f"discard {short}") == [] and kinds(f"card invoice {short}") == []
    assert kinds(f"card {'y' * 60} {short}") == [] and kinds(f"{'y' * 60}card {short}") == []
    ip = pii.find("the ship 1.2.3.4")[0]
    assert ip[3] < pii.find("the ip 1.2.3.4")[0][3] and ip[0] == "ip"
    text = "order 1.2.3.4 and serial a@b.com"
    assert [s[0] for s in pii.find(text)] == ["email", "ip"]


def test_pii_redaction_and_query(spark, odd_docs, no_docs):
    red = {r["doc_id"]: r["text"] for r in pii.redact(odd_docs).collect()}
    assert "[EMAIL] [PHONE]" in red[8] and red[3] is None and red[2] == ""
    assert all(not pii.find(t or "") for t in red.values())
    got = pii.op6(odd_docs).filter("doc_id = 8").first()
    assert (got["n_email"], got["n_phone"], got["n_card"]) == (1, 1, 0) and got["spans"].startswith("email:")
    assert pii.op6(no_docs).isEmpty() and pii.detect(no_docs).isEmpty()


# SimHash


def by_hand(docs):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [(i, fp(t)) for i, t in docs]
    near = defaultdict(list)
    distinct = sorted({f for _, f in fps})
    for a in distinct:
        near[a] = [b for b in distinct if (a ^ b).bit_count() <= 3]
    root = {}
    for f in distinct:
        if f not in root:
            stack = [f]
            while stack:
                x = stack.pop()
                if x not in root:
                    root[x] = f
                    stack += near[x]
    low = {}
    for i, f in fps:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    return [(i, f"{f:016x}", low.get(root[f])) for i, f in fps]


@pytest.mark.parametrize("tile", [2, 1024])
def test_simhash_equals_brute_force(spark, odd_docs, monkeypatch, tile):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.STRICT, tile))
    docs = odd_docs.select("doc_id", "text").unionByName(table(spark, SMALL, "documents").selectExpr("doc_id + 100 AS doc_id", "text"))
    want = sorted(by_hand([tuple(r) for r in docs.collect()]), key=lambda r: tuple((x is not None, x) for x in r))
    assert rows(simhash.op8(docs), "doc_id", "fingerprint", "component_id") == want


def test_simhash_links_within_three_bits_whatever_the_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:30].tolist():
        for _ in range(60):
            bits = rng.choice(64, int(rng.integers(1, 5)), replace=False)
            fps.add(b ^ int(sum(1 << int(k) for k in bits)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f), bytearray(np.uint64(f).tobytes())) for f in fps], "fp long, bits binary")
    for tile in (8, 1024):
        found = {tuple(r) for r in simhash.components(simhash.links(df, simhash.STRICT, tile)).collect()}
        root = {simhash.signed(f): simhash.signed(f) for f in fps} | dict(found)
        parent = {simhash.signed(f): simhash.signed(f) for f in fps}

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if (a ^ b).bit_count() <= 3:
                    x, y = sorted((top(simhash.signed(a)), top(simhash.signed(b))))
                    parent[y] = x
        assert all(root[x] == top(x) for x in root)


def test_deduplicate_keeps_one_of_each_group(spark, odd_docs, no_docs):
    kept = simhash.deduplicate(odd_docs, simhash.STRICT)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted({c if c is not None else -1 for _, _, c in by_hand([(r["doc_id"], r["text"]) for r in odd_docs.collect()])})
    assert sorted(r["doc_id"] or -1 for r in simhash.deduplicate(odd_docs).collect()) == [-1, 1, 2, 4, 6, 8]
    assert simhash.deduplicate(no_docs).isEmpty() and simhash.op8(no_docs).isEmpty()


def test_deduplicate_links_an_overlap_of_exactly_the_limit(spark):
    """8 of 10 shingles in common are 0.8 and linked; 7 of 9 are just under it and stay apart."""
    text = lambda letter, n, last: " ".join([*(f"{letter}{k}" for k in range(n)), last])
    rows = [(1, text("a", 12, "x")), (2, text("a", 12, "y")), (3, text("b", 11, "x")), (4, text("b", 11, "y"))]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


# Token files


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfiles.pack(ranks)
        assert len(control) == -(-n // 4) and (tokenfiles.unpack(control, data, n) == ranks).all()


def test_token_files_equal_the_library(spark, odd_docs, no_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = spark.createDataFrame(
        [(30, "ΣΣ ΟΣ <|endoftext|> a\x1cb c d\u0085e <|start oftext|>"), (31, "é ́x Å don't WE'LL 12345\n\n\t x")], "doc_id long, text string"
    )
    docs = odd_docs.select("doc_id", "text").unionByName(odd).unionByName(table(spark, SMALL, "documents").selectExpr("doc_id + 100 AS doc_id", "text"))
    order = [(r["doc_id"], [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, start = [], 0
    for i, ids in order:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert rows(tokenfiles.op10(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=key)
    words = tokenfiles.Words(spark, path)
    tokenfiles.write(docs, f"{tmp_path}/x", words, rows=20, block=500)
    back = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenfiles.read(spark, f"{tmp_path}/x").collect())
    assert [x for _, x in back] == [x for _, x in order] and [s for s, _ in back] == [w[1] for w in want]
    assert tokenfiles.op10(no_docs, path).isEmpty()


def test_similar_rule_finds_near_copies_and_spares_others(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    base = [rng.choice(words, 200).tolist() for _ in range(40)]
    rows, n = [], 0
    for k, b in enumerate(base):
        for copy in range(3):
            w = list(b)
            for at in rng.choice(200, copy, replace=False):
                w[at] = "changed"
            rows.append((n, " ".join(w), k))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    assert all(got[i] // 3 == i // 3 for i in got)
    assert sum(got[i] == i for i in got) <= 42


def test_similar_rule_equals_brute_force_overlap(spark):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    docs, pairs = [], {}
    for k in range(400):
        a = rng.choice(words, int(rng.integers(40, 400))).tolist()
        b = list(a)
        for at in rng.choice(len(a), max(1, int(len(a) * rng.uniform(0, 0.05))), replace=False):
            b[at] = "changed"
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = grams(docs[-2][1]), grams(docs[-1][1])
        pairs[k] = len(x & y) / len(x | y)
    # A chain of one frame in many small groups, and one group that is larger than what is compared pair by pair.
    frame = rng.choice(words, 200).tolist()
    docs += [(1000 + k, " ".join([*frame[:100], f"x{k}", *frame[100:]])) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), simhash.SIMILAR).collect()}
    linked = {k: got[2 * k] == got[2 * k + 1] for k in pairs}
    near = [k for k, j in pairs.items() if j >= 0.8]
    assert len(near) > 100 and sum(0.8 <= j < 0.9 for j in pairs.values()) > 60 and sum(0.65 < j < 0.8 for j in pairs.values()) > 60
    assert not [k for k, j in pairs.items() if j < 0.8 and linked[k]]
    assert sum(not linked[k] for k in near) <= 1
    assert {got[1000 + k] for k in range(60)} == {1000}


# Main text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<ul class="main-menu"><li><a href="/">Home</a></ul><div class="cookie-notice"><p>We use cookies on this site and you must accept them.</p></div>
<div id="w{n}"><div class="post-{n} content"><h2>Title {n}</h2><p>First&nbsp;words &amp; <b>bo</b>ld<br>here. {text}<ul><li>one<li>two</ul>
<div class="ad-box">Buy now</div><p>{text}</p><script>var x = "<p>no</p>";</script><!-- <p>hidden</p> --></div>
<aside><p>{text} {text}</p></aside><section class="comments"><p>{text} {text} {text}</p></section></div><form><p>Name</p></form><footer>(c)</footer>"""


def test_main_text(spark):
    text = "some words that make a paragraph " * 6
    pages = [(n, f"http://H.example.com:80/{n}", PAGE.format(n=n, text=text)) for n in range(5)]
    short = "<html><body><div id='w9'><div class='post-9 content'><p>Tiny words</p></div><div class='other'><p>A bit more of text</p></div></div>"
    pages += [(5, "http://h.example.com/5", short), (6, None, None), (7, "nonsense", ""), (8, "http://b.example.com/", "plain &lt; text"), (8, "http://b.example.com/", "plain &lt; text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = {r["page_id"]: r for r in htmltext.op9(df).collect()}
    want = "\n".join(["Title 3", f"First words & bold here. {text}".strip(), "one", "two", text.strip()])
    assert got[3]["text"] == want and got[3]["n_chars"] == len(want)
    assert got[5]["text"] == "Tiny words" and got[6]["text"] == "" and got[7]["n_chars"] == 0 and got[8]["text"] == "plain < text"
    assert htmltext.op9(df).count() == 10
    winner = htmltext.host_paths(df).filter("host = 'h.example.com'").first()
    assert winner["path"].endswith("div#w#>div.content.post-#") and winner["votes"] >= 5
    assert htmltext.op9(df.filter("false")).isEmpty()


LONG_TEXT = "Some plain words that make a sentence of the article. "


@pytest.mark.parametrize("outer", ['<div id="post">{}</div>', "<article>{}</article>", "<article><div>{}</div></article>", "<main><div class='x'>{}</div></main>"])
@pytest.mark.parametrize("shares", [(19, 6), (2, 16, 2), (10, 10), (1, 30, 1)])
def test_articles_in_parts_are_kept_whole(outer, shares):
    parts = [(LONG_TEXT * n).strip() for n in shares]
    body = outer.format("".join(f'<div class="part{k}"><p>{t}</p></div>' for k, t in enumerate(parts)))
    page = f"<html><body><nav><a href=1>Home</a></nav>{body}<ul class=links><li><a href=2>More of this</a></ul><footer>(c)</footer></body></html>"
    assert htmltext.extract(page) == "\n".join(parts)
    path, _ = htmltext.vote(page)
    assert htmltext.extract(page, path) == "\n".join(parts)


def test_names_of_parts_of_articles():
    t = LONG_TEXT.strip()
    inside = f"""<h1>Title</h1><div class="legal-analysis"><p>{t}</p></div><section id="related-work"><p>{t}</p></section><p><label>Label</label> {t}</p>
<div class="related-posts"><a href=1>Another article of this site</a></div><div class="share">Share</div><div class="ad-box">{t}</div>
<section class="comments"><p>{t}</p></section><header>By me</header>"""
    assert htmltext.extract(f"<html><body><article>{inside}</article></body></html>").split("\n") == ["Title", t, t, f"Label {t}", "By me"]


def test_deep_pages_take_linear_time():
    text = LONG_TEXT.strip()
    for n in (1_000, 100_000):
        page = "<html><body>" + "<div>" * n + f"<p>{text}</p>" + "</div>" * n + "</p></span>" * n
        assert htmltext.extract(page) == text
        assert htmltext.vote(page)[0] == ">html>body" + ">div" * n
    tied = f"<html><body><div class=a><p>{text}</p></div><p>x</p><div class=b><p>{text}</p></div></body></html>"
    assert htmltext.vote(tied)[0] == ">html>body" and htmltext.extract(tied) == f"{text}\nx\n{text}"


def test_main_text_of_the_tables(spark):
    pages = table(spark, SMALL, "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in htmltext.op9(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|\Z)", source[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h\d)>", article)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
        assert r["text"] == "\n".join(b for b in blocks if b)


# Language-model scores


def test_scores_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(ngramlm.SQL).fetchall()}
    got = {r["doc_id"]: (r["n_words"], r["score"], r["score_per_word"]) for r in ngramlm.op1(table(spark, SMALL, "documents")).collect()}
    assert got.keys() == want.keys()
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-3) for a, b in zip(got.values(), (want[k] for k in got), strict=True))


def scores_by_hand(docs, train, order):
    """(words, score) of each text under the counts of ``train``, or of all other texts."""

    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    def count(texts):
        return Counter(tuple(t[i - k : i]) for t in texts for k in range(1, order + 1) for i in range(k, len(t) + 1))

    own = [words(t) for t in docs]
    base = own if train is None else [words(t) for t in train]
    every, n, out = count(base), sum(map(len, base)), []
    for t in own:
        less, left = (count([t]), n - len(t)) if train is None else (Counter(), n)

        def c(g, less=less):
            return every[g] - less[g]

        def s(g, left=left, c=c):
            if len(g) == 1:
                return math.log(max(1, c(g)) / max(1, left))
            return math.log(c(g) / c(g[:-1])) if c(g) else math.log(ngramlm.ALPHA) + s(g[1:])

        out.append((len(t), sum(s(tuple(t[max(0, i - order + 1) : i + 1])) for i in range(len(t)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, odd_docs, no_docs, monkeypatch, order):
    """Small blocks and buckets, so that n-grams meet over many of both."""
    monkeypatch.setattr(ngramlm, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(ngramlm, "BUCKET_GRAMS", 2_000)
    docs = odd_docs.select("doc_id", "text").unionByName(table(spark, SMALL, "documents").select("doc_id", "text").filter("doc_id > 150"))
    whole = [tuple(r) for r in docs.collect()]
    other = [r["text"] for r in table(spark, SMALL, "documents").filter("doc_id < 20").collect()]
    for train in (None, other) if order == 3 else (None,):
        frame = None if train is None else spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string")
        want = sorted(((i is not None, i or 0, *w) for (i, _), w in zip(whole, scores_by_hand([t for _, t in whole], train, order), strict=True)))
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["score"]) for r in ngramlm.score(docs, frame, order).collect())
        assert len(got) == len(want) and all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6) for a, b in zip(got, want, strict=True))
    assert ngramlm.op1(no_docs).isEmpty() and ngramlm.score(no_docs, no_docs).isEmpty() and ngramlm.score(no_docs, docs).isEmpty()


def test_many_short_documents_in_one_block(spark):
    """More documents in a batch than 16 bits can number."""
    n = 70_000
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        docs = spark.range(0, n, 1, 1).selectExpr("id AS doc_id", "concat('w', id % 5, ' x', if(id = 69999, ' z', '')) AS text")
        got = {r["doc_id"]: r["score"] for r in ngramlm.score(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    m, each = 2 * n + 1, n // 5 - 1
    want = [math.log(each / (m - 2)) + math.log(each / each)] * (n - 1)
    want.append(math.log(each / (m - 3)) + math.log(each / each) + 2 * math.log(ngramlm.ALPHA) + math.log(1 / (m - 3)))
    assert len(got) == n and all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))


def test_backoff(spark):
    train = spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, "c a"), (3, "zz"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngramlm.score(docs, train).collect()}
    assert got[1] == pytest.approx(np.log(2 / 5) + np.log(2 / 2)) and got[2] == pytest.approx(np.log(1 / 5) + np.log(0.4 * 2 / 5))
    assert got[3] == pytest.approx(np.log(1 / 5)) and got[4] == 0.0


# Quality


def test_content_view_covers_all_words():
    words = [f"w{i}" for i in range(1000)]
    want = np.zeros(cotrain.BUCKETS)
    for w in words:
        want[zlib.crc32(w.encode()) % cotrain.BUCKETS] += 1 / len(words)
    assert np.allclose(cotrain.content(" ".join(words))[98:], want, atol=1e-5)


def test_quality_held_out_accuracy(spark, odd_docs, no_docs):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    got = cotrain.op7(docs, labels)
    assert got.count() == docs.count()
    scored = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() >= 0.97
    more = odd_docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
    assert {r["score"] for r in cotrain.op7(more, labels.filter("false")).collect()} == {0.5}
    model = cotrain.fit(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in cotrain.score(more, model).collect())
    assert cotrain.score(no_docs.withColumns({"lang": F.lit("x"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")}), model).isEmpty()


def test_sums_over_unlabelled_rows_equal_one_matrix(spark):
    """What tasks add up equals the same sums over all rows at once, and no row is left out."""
    rng = np.random.default_rng(2)
    n, sizes = 3_000, (7, 5)
    x = [rng.normal(size=(n, k)).astype(np.float32) for k in sizes]
    rows = spark.createDataFrame([(bytes(p.tobytes()), bytes(q.tobytes())) for p, q in zip(*x, strict=True)], "a binary, b binary").repartition(7)
    views = [rng.normal(size=k + 1) for k in sizes]
    history = [[(rng.normal(size=k + 1), -1.5, 2.0), (rng.normal(size=k + 1), -2.0, 1.0)] for k in sizes]
    free = cotrain.Unlabelled(rows)
    got = free.sums(views, history)
    for v in (0, 1):
        y = cotrain.pseudo_labels(x[1 - v], history[1 - v])
        some = ~np.isnan(y)
        assert 100 < some.sum() < n and {0.0, 1.0} == set(y[some].tolist())
        # A row's label comes from the other view, its features from this one.
        want = cotrain._sums(x[v][some], y[some], np.full(int(some.sum()), cotrain.PSEUDO), views[v])
        assert all(np.allclose(g, w) for g, w in zip(got[v], want, strict=True))
    at = free.thresholds(views, history, 0.1, 0.95)
    for v in (0, 1):
        left = np.isnan(cotrain.pseudo_labels(x[v], history[v]))
        z = np.sort(x[v][left] @ views[v][:-1] + views[v][-1])
        assert at[v][0] == pytest.approx(z[int(0.1 * len(z))], abs=0.05) and at[v][1] == pytest.approx(z[int(0.95 * len(z))], abs=0.05)


def test_labels_that_disagree_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s", "en", 6) for i in range(40)] + [(1, "a text", "s", "en", 6)], "doc_id long, text string, source string, lang string, n_chars long")
    both = [(i, i % 2, i % 2) for i in range(40)] + [(i, 1, 1) for i in range(0, 40, 4)] + [(1, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(both, "doc_id long, quality int, toxic int")
    learnt = {i for i in range(40) if i % 4 and zlib.crc32(str(i).encode()) % 3 != 1}
    got = toxicity.sample(docs, labels).collect()
    assert {(r["doc_id"], r["toxic"]) for r in got} == {(i, i % 2) for i in learnt} and len(got) == len(learnt)
    assert all(r["text"] == ("a text" if r["doc_id"] == 1 else f"text {r['doc_id']}") for r in got)


def test_scoring_tasks_are_bounded_and_each_block_has_one(spark):
    blocks = spark.createDataFrame([((i // 7 << 32) + i % 7,) for i in range(500)], "block long")
    ids = sorted(r["block"] for r in blocks.collect())
    assert ngramlm._task_bounds(blocks) == ids[1:]
    few = ngramlm._task_bounds(blocks, 7)
    assert len(few) == 6 and set(few) <= set(ids)
    sizes = np.diff([0, *(ids.index(b) for b in few), len(ids)])
    assert sizes.min() >= 71 and sizes.max() <= 72
    assert ngramlm._task_bounds(blocks.limit(1)) == ngramlm._task_bounds(blocks.limit(0)) == []
