"""The corpus operators against brute force, exact round trips and held-out accuracy, with odd rows:
nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, comp int"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "sea", "tree", "house", "river", "stone", "light", "bird"]) + str(r.randint(0, 60)) for _ in range(n))


def texts():
    r = random.Random(4)
    out = [prose(r, n) for n in (30, 60, 120, 200, 7, 5, 4, 1)]
    base = prose(r, 150).split()
    for k in range(12):  # near copies of one text
        w = list(base)
        w[3 + 10 * k] = f"x{k}"
        out.append(" ".join(w))
    far = list(base)
    for k in range(0, 150, 9):
        far[k] = f"far{k}"
    out += [" ".join(far), None, "", "   \n\t ", "Same  Text\nhere", "Same  Text\nhere", "SAME  TEXT\nHERE", "one line\none line\n\none line", "ünï çødé 日本語 text " * 9, "w " * 3000 + "end"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], "s" + str(i % 2), 0, 1, "t", 2) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "no id " + texts()[1], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY)


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join(docs, none):
    from ruleweave.llm.ngram_join import ngram_components

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    expected = Counter((d, len(sets[i]), min(least[find(i)], default=d)) for i, (d, _) in enumerate(rows))
    got = Counter(tuple(r) for r in ngram_components(docs).collect())
    assert got == expected
    assert ngram_components(none).count() == 0


def test_pairs_and_filters():
    from ruleweave.llm import ngram_join as J

    r = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(r.integers(0, 80, 60)).astype(np.uint64)
        y = np.unique(np.where(r.random(len(x)) < 0.1, r.integers(0, 80, len(x)), x)).astype(np.uint64)
        both = len(np.intersect1d(x, y))
        exact = 100 * both >= 80 * (len(x) + len(y) - both)
        df = {int(t): 1 + int(t) % 5 for t in np.concatenate((x, y))}
        c = [J._first_tokens(s, np.array([df[int(t)] for t in s]), len(s)) for s in (x, y)]
        assert J.linked(x, y, c[0][1], c[1][1]) == exact
        if exact:
            assert set(c[0][0].tolist()) & set(c[1][0].tolist())


def test_prefix_shares_at_the_boundary(spark):
    from ruleweave.llm import ngram_join as J

    r = np.random.default_rng(2)
    for n in range(1, 51):
        for m in range(n, n * 100 // 80 + 1):
            for c in range(-(-80 * (n + m) // 180), n + 1):
                for _ in range(20):
                    t = r.permutation(n + m - c)
                    sets = np.sort(t[:n]), np.sort(np.concatenate((t[:c], t[n:])))
                    live = np.intersect1d(*(s[: J.long_prefix(len(s))[0]] for s in sets))
                    assert all(len(live) >= J.long_prefix(len(s))[1] for s in sets), (n, m, c)
    sizes = spark.range(1, 600).select("id", J.least_live(F.col("id")).alias("k")).collect()
    for x in sizes:
        m, need = min(x.id, 2 * (x.id - J.needed(x.id) + 1)), range(J.needed(x.id), x.id * 100 // 80 + 1)
        shared = [min(m - (x.id - c), min(k, 2 * (k - J.needed(k) + 1)) - (k - c)) for k in need for c in (-(-80 * (x.id + k) // 180),)]
        assert x.k == J.long_prefix(x.id)[1] == min(shared) >= 1
    # pairs of texts with words of their own: n shingles, and the same text with words added at an end
    rows, expected = [], {}
    for n in range(1, 51):
        for m in range(n, n * 100 // 80 + 2):
            a = len(rows)
            words = [f"w{a}x{i}" for i in range(m + 4)]
            rows += [(a, " ".join(words[: n + 4])), (a + 1, " ".join(words if m % 2 else words[n + 4 :] + words[: n + 4]))]
            expected |= {a: a, a + 1: a if 100 * n >= 80 * m else a + 1}
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: g.component_id for g in got} == expected


def pieces(t):
    return set(re.findall(r"(?:[^ \n]{1,16}+ *+){1,12}+", t))


def test_fingerprints(docs, none):
    from ruleweave.llm.fingerprints import fingerprint_edits

    got = fingerprint_edits(docs).collect()
    assert len(got) == docs.count()
    single = docs.where("doc_id between 1 and 30")
    rows = sorted(((r.doc_id, r.text or "") for r in single.collect()), reverse=True)
    out = {r.doc_id: r for r in fingerprint_edits(single).collect()}
    for k, (d, t) in enumerate(rows):
        follows = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follows[:cut]
        assert out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[d].n_chars == len(t)
        for other, like in ((edited, out[d].near_edited), (follows, out[d].near_next)):
            a, b = pieces(t), pieces(other)
            assert like == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert (out[d].n_only_before, out[d].n_only_after) == (len(pieces(t) - pieces(edited)), len(pieces(edited) - pieces(t)))
    by_text = defaultdict(set)
    for r in got:
        by_text[r.doc_id].add(r.fingerprint)
    assert by_text[24] == by_text[25] and by_text[0] != by_text[1] and len(by_text[0]) == 1
    assert fingerprint_edits(none).count() == 0
    assert fingerprint_edits(single.where("doc_id = 3")).first().near_next == 1.0


def test_fingerprints_compare_exactly_where_no_sketch_decodes(spark, monkeypatch):
    from ruleweave.llm import fingerprints as P

    monkeypatch.setattr(P, "SIZES", [4])
    monkeypatch.setattr(P, "LOAD", 200)  # far too many digests for a sketch of four columns
    r = random.Random(3)
    base = [prose(r, 9) for _ in range(60)]
    rows = [(2, "\n".join(base)), (1, "\n".join(base[:20] + [prose(r, 9) for _ in range(40)]))]
    got = {x.doc_id: x for x in P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = (pieces(t) for _, t in rows)
    assert got[2].near_next == pytest.approx(len(a & b) / len(a | b)) and 0.1 < got[2].near_next < 0.5
    t = rows[0][1]
    edited = pieces(t[: len(t) - len(t) // 3] + rows[1][1][: len(t) // 3])
    assert got[2].near_edited == pytest.approx(len(a & edited) / len(a | edited))
    assert (got[2].n_only_before, got[2].n_only_after) == (len(a - edited), len(edited - a))


def test_fingerprints_of_scripts_without_spaces_and_many_equal_ids(spark):
    from ruleweave.llm.fingerprints import fingerprint_edits

    r = random.Random(5)
    chinese = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(900))
    got = {x.doc_id: x for x in fingerprint_edits(spark.createDataFrame([(2, chinese), (1, "other " * 300)], "doc_id long, text string")).collect()}
    assert got[2].near_edited > 0.3
    # most rows share one id: they are dealt by their texts, and each is followed by the next in order
    rows = [(7, f"text {i % 150} of many") for i in range(400)] + [(None, f"none {i}") for i in range(300)] + [(i, f"own {i}") for i in (1, 2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from ruleweave.llm.fingerprints import with_next

    pairs = Counter((x.text, x.next_text) for x in with_next(docs).collect())
    assert sum(pairs.values()) == len(rows) and Counter(t for t, _ in pairs.elements()) == Counter(n for _, n in pairs.elements()) == Counter(t for _, t in rows)
    follow = {}
    for t, n in pairs:
        follow.setdefault(t, set()).add(n)
    assert follow["own 9"] <= {t for d, t in rows if d == 7} and follow["own 2"] == {"own 1"} and next(iter(follow["own 1"])).startswith("none") and sum("own 9" in n for n in follow.values()) == 1


def test_warc(spark, tmp_path):
    from ruleweave.llm import warc as W

    big = "<p>" + "long " * 400
    rows = [(1, "http://a/é\r\nx", big, 9), (5, None, big, 9), (3, "http://b", big, 9), (2, "http://c", "small", 9), (4, "u", "small", 9), (6, "u", None, 9), (7, "u", "", 9), (8, "u", "ü" * 600000, 9), (5, "again", big, 9), (None, "u", big, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    got = Counter(tuple(r) for r in W.archive_pages(pages).collect())
    expected = Counter()
    for p, _, h, _ in rows:
        b = (h or "").encode()
        last = max(q for q, _, g, _ in rows if q is not None and (g or "") == (h or ""))
        again = len(b) >= 1000 and (p is None or p < last)
        expected[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None)] += 1
    assert got == expected
    assert W.archive_pages(pages.limit(0)).count() == 0
    # a monolithic stream of one member becomes members that each inflate alone; so does one of many
    records = [W.record(i, "u", bytes([i]) * 10, None) for i in range(5)]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.gz").write_bytes(gz.compress(b"".join(records)) + gz.flush())
    assert W.normalise_file(f"file://{tmp_path}/a.gz", f"file://{tmp_path}/b.gz") == 5
    assert W.normalise_file(f"file://{tmp_path}/b.gz", f"file://{tmp_path}/c.gz") == 5
    assert (tmp_path / "b.gz").read_bytes() == (tmp_path / "c.gz").read_bytes()
    assert [b.rpartition(b"\r\n\r\n")[2] for _, b in W.read_file(f"file://{tmp_path}/c.gz")] == [bytes([i]) * 10 for i in range(5)]


def test_simple8b():
    from ruleweave.llm import token_files as S

    r = np.random.default_rng(2)
    for bits in (1, 3, 9, 16, 31, 59, 62, 64):
        for n in (0, 1, 5, 239, 240, 1000):
            x = r.integers(0, 1 << min(bits, 63), n, dtype=np.uint64) * np.uint64(2 if bits == 64 else 1)
            x[: n // 3] = 0
            if n > 3:
                x[2] = (1 << 60) - 1
            assert (S.decode_block(S.encode_block(x)) == x).all()


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)])
def test_memo_encoder(name, end):
    from tokenizers import Tokenizer

    from ruleweave.llm.tokens import TextEncoder

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    e, r = TextEncoder(public_tokenizers.path(name)), random.Random(3)
    letters = "ab Z9'é\nß_.,!$½²ª-—…ŉİ  \n\tдΣ日"
    samples = ["".join(r.choice(letters[: r.choice((10, 26, 33))]) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    for x in [*samples, "it's we'll <|endoftext|> x", " lead", "trail ", "\n\n", *[t for t in texts() if t]]:
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


SPECIAL = ["first part <|endoftext|> second part", "<|endoftext|>", "a<|startoftext|>b\n\n<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "日 <|endoftext|><|endoftext|> x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_as_the_library(spark, name):
    from tokenizers import Tokenizer

    from ruleweave.llm.packing import pack_documents
    from ruleweave.llm.token_files import read_token_files, write_token_files
    from ruleweave.llm.tokens import encoder

    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    ids = [t.encode(x, add_special_tokens=False).ids for x in SPECIAL]
    assert [np.frombuffer(encoder(path)(x), "<u4").tolist() for x in SPECIAL] == ids
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    end = 0 if name.startswith("byte") else 1
    crc = {d: (len(x) + 1, zlib.crc32(np.array([*x, end], "<u4").tobytes())) for d, x in enumerate(ids)}
    if end:
        assert {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(docs, path).collect()} == crc
    else:
        assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in read_token_files(spark, write_token_files(docs, path)).collect()} == crc


def test_token_files(docs, none, spark):
    from tokenizers import Tokenizer

    from ruleweave.llm.token_files import read_token_files, write_token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in read_token_files(spark, write_token_files(docs, path)).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    start = 0
    for (d, text), g in zip(rows, got, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert g == (None if d == -1 else d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert read_token_files(spark, write_token_files(none, path)).count() == 0


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    from ruleweave.llm import kernels as K
    from ruleweave.llm.fingerprints import fingerprint_edits
    from ruleweave.llm.ngram_join import ngram_components
    from ruleweave.llm.packing import pack_documents
    from ruleweave.llm.quality_rules import base_counts
    from ruleweave.llm.token_files import read_token_files, write_token_files

    r = random.Random(23)
    words = [r.choice(["sea", "tree", "höuse", "river"]) + str(r.randint(0, 9999)) for _ in range(150_000)]
    long = "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40)) + " " + "z" * 50_000
    assert len(long.encode()) > K.WINDOW + K.SLICE
    rows = [(1, long), (2, long + " one more"), (3, "short text of a few words"), (4, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_components(docs).collect()}
    assert got == {d: (len(shingles(t)), {1: 1, 2: 1, 3: 3, 4: 4}[d]) for d, t in rows}
    prints = {x.doc_id: x for x in fingerprint_edits(docs.where("doc_id < 4")).collect()}
    assert all(prints[d].n_chars == len(t) for d, t in rows[:3]) and prints[2].near_next > 0.99
    edited = (long + " one more")[: len(long) + 9 - (len(long) + 9) // 3] + long[: (len(long) + 9) // 3]
    assert prints[2].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        ids = {d: [*t.encode(x, add_special_tokens=False).ids, end] for d, x in rows}
        if end:
            expected = Counter((d, k, zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for d, x in ids.items() for k, a in enumerate(range(0, len(x), 4096)))
            assert Counter((p.doc_id, p.piece, p.ids_crc32) for p in pack_documents(docs, public_tokenizers.path(name)).collect()) == expected
        else:
            back = {p.doc_id: (p.n_tokens, p.ids_crc32) for p in read_token_files(spark, write_token_files(docs, public_tokenizers.path(name))).collect()}
            assert back == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids.items()}
    import pyarrow as pa

    counts = base_counts(pa.RecordBatch.from_pydict({"text": [long]}))
    assert counts["n_words"][0] == len(WORD.findall(long)) and counts["word_chars"][0] == sum(map(len, WORD.findall(long)))


def test_joins_of_hot_keys(spark):
    from ruleweave.llm.shared import HOT, join_rows

    left = spark.range(6000).selectExpr("id", "case when id < 4000 then 7 when id % 11 = 0 then null when id < 4200 then 9 else id end as k")
    right = spark.range(5000).selectExpr("id as k", "id * 2 as x").where("k != 9")
    for how in ("inner", "left"):
        got = Counter(tuple(r) for r in join_rows(left, right, "k", how).select("id", "k", "x").collect())
        assert got == Counter(tuple(r) for r in left.join(right, "k", how).select("id", "k", "x").collect())
    assert 4000 > 6000 // HOT and join_rows(left.limit(0), right, "k", "left").count() == 0


def test_folders_must_be_named_on_a_cluster(spark, monkeypatch):
    from ruleweave.llm.shared import shared_dir

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_packing(docs, none, monkeypatch):
    from tokenizers import Tokenizer

    from ruleweave.llm import packing
    from ruleweave.llm.packing import best_fit, pack_documents, pack_pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = [tuple(r) for r in pack_documents(docs, path, capacity=256).collect()]
    expected = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            expected[(r.doc_id, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()))] += 1
    assert Counter(g[:5] for g in got) == expected
    bins = defaultdict(list)
    for g in got:
        bins[g[5]].append((g[6], g[3]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1 + 1.1 * sum(g[3] for g in got) / 256
    assert pack_documents(none, path).count() == 0
    where, offset, fill = best_fit(np.array([5, 5, 4, 3, 2, 1]), 10)
    assert sorted(fill.tolist()) == [10, 10] and len(set(zip(where.tolist(), offset.tolist(), strict=True))) == 6
    monkeypatch.setattr(packing, "MERGE_ITEMS", 500)  # several tasks and rounds
    many = docs.sparkSession.range(0, 4000, 1, 40).selectExpr("id as item", "1 + pmod(hash(id), 90) as length")
    placed = pack_pieces(many.withColumn("length", F.col("length").cast("long")), 100).join(many, "item")
    sizes = placed.groupBy("bin").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in sizes) <= 100 and len(sizes) <= 1.04 * sum(r.n for r in sizes) / 100 + 1


def test_language(spark, none):
    from ruleweave.llm.language import identify, keep_languages

    r = random.Random(7)
    parts = {"aa": "ka ro mi tu zo".split(), "bb": "sch ung ein der lich".split()}
    rows = []
    for i in range(300):
        lang = ("aa", "bb")[r.random() < 0.3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(12)), lang, 1))
    rows += [(900, None, "aa", 1), (901, "12 -- !", "bb", 1), (902, "", None, 1), (None, "karomi", "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket int")
    got = identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    real = {r[0]: r[2] for r in rows[:300]}
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    assert sum(real[g.doc_id] == g.lang_pred for g in got if g.doc_id in real and g.held_out) >= 0.98 * sum(g.held_out for g in got if g.doc_id in real)
    assert {g.doc_id: g.lang_pred for g in got if g.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    kept = keep_languages(docs)
    assert kept.columns == docs.columns and kept.count() == 301
    assert identify(none).count() == 0 and keep_languages(none).count() == 0
    assert {g.lang_pred for g in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def gram_counts(text):
    """Character 1- to 3-grams of a text, as language identification takes them."""
    t = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != " ")


def test_language_by_a_plain_model(spark):
    from ruleweave.llm import kernels as K
    from ruleweave.llm import language as L

    r = random.Random(17)
    parts = {"aa": "ka ro mi tu zo é", "bb": "sch ung ein der lich ka", "cc": "日 本 語 の ka"}
    rows = [(i, " ".join("".join(r.choice(parts[x].split()) for _ in range(3)) for _ in range(r.randint(1, 20))), x) for i in range(240) for x in [("aa", "bb", "cc")[i % 3 if i % 7 else 0]]]
    rows += [(500, "Ka, RO!!  mi--tu\n\nzo 12", "aa"), (501, "", "aa"), (502, None, "bb"), (503, "ka " * (K.SLICE // 2), "bb"), (504, "sch 12 ", None), (None, "ka ro", "aa"), (505, "ung", "bb"), (505, "ung", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d, *_ in rows}
    counts, n = defaultdict(Counter), Counter()
    for d, t, x in rows:
        if d is not None and not held[d] and x is not None and t is not None:
            counts[x] += gram_counts(t)
            n[x] += 1
    # 65,536 buckets for some hundred grams: a gram's bucket is its own but for rare clashes
    def bucket(g):
        key = len(g)
        for c in g:
            key = key << 20 | ord(c)
        return int(K.mix(np.array([key], np.uint64))[0]) & (L.BUCKETS - 1)

    by = {x: Counter() for x in counts}
    for x, c in counts.items():
        for g, k in c.items():
            by[x][bucket(g)] += k
    langs = sorted(counts)
    expected = Counter()
    for d, t, _ in rows:
        grams = gram_counts(t or "")
        if not any(c.isalpha() for c in t or ""):
            expected[d, held[d], "und", 0.0] += 1
            continue
        logs = [math.log(n[x] / sum(n.values())) + sum(k * math.log((by[x][bucket(g)] + L.SMOOTHING) / (sum(by[x].values()) + L.SMOOTHING * L.BUCKETS)) for g, k in grams.items()) for x in langs]
        best = max(range(len(langs)), key=lambda i: (logs[i], -i))
        expected[d, held[d], langs[best], round(1 / sum(math.exp(v - logs[best]) for v in logs), 2)] += 1
    assert Counter((g.doc_id, g.held_out, g.lang_pred, round(g.score, 2)) for g in L.identify(docs).collect()) == expected


def test_stretches_of_long_texts_give_each_gram_once():
    import pyarrow as pa

    from ruleweave.llm import kernels as K
    from ruleweave.llm import language as L
    from ruleweave.llm import resampling as R

    r = random.Random(2)
    text = "".join(r.choice("ab é日 \n.") for _ in range(5000))
    for features, size in ((lambda c: ((b, o) for b, o, _ in L.features(c)), L.BUCKETS), (R.features, 2 * R.BUCKETS)):
        whole = sum(np.bincount(b, minlength=size) for b, _ in features(pa.array([text])))
        old = K.stretches.__defaults__
        try:
            K.stretches.__defaults__ = (97,)
            assert (sum(np.bincount(b, minlength=size) for b, _ in features(pa.array([text]))) == whole).all()
        finally:
            K.stretches.__defaults__ = old


def test_keep_languages_decides_by_the_model(spark):
    from ruleweave.llm.language import keep_languages

    r = random.Random(8)
    parts = {"aa": "ka ro mi tu zo", "bb": "sch ung ein der lich", "cc": "qua plo wex"}

    def say(pieces, words):
        return " ".join("".join(r.choice(pieces.split()) for _ in range(3)) for _ in range(words))

    rows = [(i, say(parts[x], r.randint(4, 60)), x) for i in range(400) for x in [r.choice(("aa", "bb"))]]
    rows += [(i, say(parts["cc"], 20), "cc") for i in range(400, 408)]  # few to learn from
    clean = {x[0] for x in rows}
    noise = "".join(map(chr, range(97, 123)))
    odd = ["".join(r.choice(noise) for _ in range(n)) for n in (80, 300)] + [" ".join("".join(r.choice(noise) for _ in range(6)) for _ in range(n)) for n in (15, 100)]
    odd += ["Это обычное предложение о погоде и о море", "今日は天気がいいので散歩に行きました今日は", "Ένα μικρό κείμενο για τη θάλασσα και τον ήλιο"]
    rows += [(900 + i, t, ("aa", None)[i % 2]) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # learned from clean rows only where the odd ones are held out or without a language
    learn = docs.withColumn("lang", F.when(F.col("doc_id") < 900, F.col("lang")))
    kept = keep_languages(learn)
    assert {x.doc_id for x in kept.collect()} == clean and kept.columns == docs.columns


def test_resampling(spark):
    from ruleweave.llm.resampling import importance_sample, kth_largest, log_ratios, resample

    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = r.random() < 0.8
        rows.append((i, " ".join(r.choice("abcdefgh") * 2 if good else r.choice("XYZ") * 3 + "$$" for _ in range(40)), 5))
        labels += [(i, int(good), 0)] if i % 2 else []
    rows += [(900, None, 5), (901, "", 5), (None, "aa bb cc dd", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in importance_sample(docs, marks).collect()}
    good = {i for i, t, _ in rows[:400] if "$" not in t}
    assert len(good - kept) <= 2 and len(kept - good - {900, 901, None}) <= 2
    assert importance_sample(docs, marks, 50).count() == 50
    back = resample(docs, marks)
    assert back.columns == docs.columns and {x.doc_id for x in back.collect()} == kept
    assert importance_sample(docs.limit(0), marks).count() == 0
    assert importance_sample(docs, marks.limit(0), 10).count() == 10
    x = spark.range(30_000).selectExpr("cast(hash(id) as double) as x")
    values = sorted((v[0] for v in x.collect()), reverse=True)
    assert [kth_largest(x, "x", k) for k in (1, 777, 29_999)] == [values[0], values[776], values[29_998]]
    ratios = log_ratios(np.array([0, 1]), np.array([100, 100]), np.array([50, 0]))
    assert ratios[0] > 0 > ratios[1]


def test_resampling_by_plain_weights(spark):
    from ruleweave.llm import kernels as K
    from ruleweave.llm import resampling as R

    r = random.Random(19)
    rows = [(i, " ".join(r.choice("aa bb cc dd ee ff".split() if i % 4 else "XX YY$ ZZ".split()) for _ in range(r.randint(1, 30))), ("x", "y", None)[i % 3]) for i in range(120)]
    rows += [(200, None, "x"), (201, "", "y"), (None, "aa bb", "x"), (5, rows[5][1], rows[5][2]), (202, "aa " * (K.SLICE // 2), "x")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 120, 2)] + [(2, 0, 0), (6, 1, 1), (7, None, None), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdicts = defaultdict(list)
    for d, q, t in labels:
        if d is not None:
            verdicts[d].append(q == 1 and t == 0)
    good = {d for d, v in verdicts.items() if all(v)}

    def buckets(t):
        b = (t or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", b)
        import pyarrow as pa

        hashed = K.words(*K.strings(pa.array([w.decode() for w in words])))[2] if words else np.zeros(0, np.uint64)
        chars = K.mix(np.array([int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3)], np.uint64))
        return Counter((hashed & np.uint64(R.BUCKETS - 1)).tolist()), Counter((chars & np.uint64(R.BUCKETS - 1)).tolist())

    size, target_size = Counter(), Counter()
    for d, t, x in rows:
        size[x or ""] += len((t or "").encode())
        target_size[x or ""] += len((t or "").encode()) * (d in good)
    raw, target = (Counter(), Counter()), (Counter(), Counter())
    for d, t, x in rows:
        for half, c in enumerate(buckets(t)):
            for k, n in c.items():
                raw[half][k] += n * target_size[x or ""] / size[x or ""]
                target[half][k] += n * (d in good)
    expected = []
    for d, t, _ in rows:
        weight = 0.0
        for half, c in enumerate(buckets(t)):
            scale = sum(target[half].values()) / sum(raw[half].values())
            weight += sum(n * math.log((target[half][k] + R.SMOOTHING) / (raw[half][k] * scale + R.SMOOTHING)) for k, n in c.items())
        expected.append((d, weight))
    all_rows = R.importance_sample(docs, marks, len(rows)).collect()  # as many as there are: none is left out
    assert len(all_rows) == len(rows)
    for g in all_rows:
        assert any(d == g.doc_id and abs(w - g.log_weight) <= 1e-3 + 1e-4 * abs(w) for d, w in expected), g
    # the default size of the sample, and which rows it takes
    share = np.mean([v for v in (all(x) for x in verdicts.values())])
    k = round(sum(min(1.0, share * math.exp(min(w, 700.0))) for _, w in expected))
    keys = sorted((g.sample_key for g in all_rows), reverse=True)
    taken = R.importance_sample(docs, marks)
    assert sorted(g.sample_key for g in taken.collect()) == sorted(x for x in keys if x >= keys[k - 1])
    noise = {g.doc_id: g.sample_key - g.log_weight for g in all_rows}
    assert len({round(x, 6) for x in noise.values()}) == len(noise) and abs(np.mean(list(noise.values())) - 0.5772) < 0.5


def test_clashing_columns_stay(spark):
    from ruleweave.llm.mixing import replicate
    from ruleweave.llm.resampling import resample

    names = ["log_weight", "sample_key", "mix_source", "mix_order", "node", "good", "share", "n", "w"]
    docs = spark.range(60).selectExpr("id as doc_id", "concat('some words ', id % 7) as text", "'en' as lang", "concat('s', id % 3) as source", *(f"id * 2 as `{c}`" for c in names))
    labels = spark.range(60).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    kept = resample(docs, labels, 20)
    assert kept.columns == docs.columns and kept.count() == 20 and kept.where("log_weight != doc_id * 2").count() == 0
    out = replicate(docs.withColumn("mix_rate", F.lit("mine")))
    assert out.columns == [*docs.columns, "mix_rate", "mix_count", "mix_copy"] and out.where("mix_source != doc_id * 2 or mix_rate <= 0").count() == 0
    no_ids = replicate(docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", "n")), {"s0": 1.0, "s1": 1.0, "s2": 1.0})
    assert no_ids.select("text", "mix_count").distinct().groupBy("text").count().where("count > 1").count() == 0 and no_ids.count() > 0


def test_resampling_takes_no_language_away(spark):
    from ruleweave.llm.resampling import importance_sample

    r = random.Random(10)
    words = {"aa": ["ka", "ro", "mi", "tu", "zo"], "bb": ["schung", "einder", "lich", "dass", "und"], None: ["qu", "wex", "plo"]}
    rows, labels = [], []
    for i in range(600):
        lang, good = r.choice(("aa", "aa", "bb", None)), r.random() < 0.8
        rows.append((i, " ".join("".join(r.choices(words[lang], k=2)) + ("" if good else "$$$") for _ in range(200)), lang))
        # most of the good of bb have no label
        labels += [(i, int(good), 0)] if r.random() < (0.15 if lang == "bb" else 0.6) else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in importance_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for lang in words:
        good = {i for i, t, x in rows if x == lang and "$" not in t}
        bad = {i for i, t, x in rows if x == lang and "$" in t}
        assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.1 * len(bad), lang


def test_resampling_keeps_good_of_each_language(spark):
    from ruleweave.llm.resampling import importance_sample

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {x.doc_id for x in importance_sample(docs, labels).collect()}
    marks = {x.doc_id: x.quality == 1 and x.toxic == 0 for x in labels.collect()}
    by = defaultdict(list)
    for x in docs.select("doc_id", "lang").collect():
        by[x.lang] += [x.doc_id in kept] if marks.get(x.doc_id) else []
    assert len(by) >= 4 and all(np.mean(k) >= 0.95 for k in by.values()), {x: np.mean(k) for x, k in by.items()}


def test_quality_rules(docs, none):
    from ruleweave.llm.quality_rules import quality_rules

    got = {}
    for g in quality_rules(docs.where("doc_id is not null")).collect():
        got[g.doc_id] = g
    for r in docs.where("doc_id is not null").collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (g.base_failed and g.kept)
    assert quality_rules(none).count() == 0


def kneser_ney(rows, order=3):
    """Log-perplexity of each (lang, text) by a plain modified Kneser-Ney model of all of them."""
    out = {}
    for lang in {x for x, _ in rows}:
        mine = [t or "" for x, t in rows if x == lang]
        grams = [[("\x02" * (order - 1) + t)[i : i + order] for i in range(len(t))] for t in mine]
        n, docs = Counter(g for t in grams for g in t), Counter(g for t in grams for g in set(t))
        levels = [{g: n[g] if docs[g] > 1 else 0 for g in n}]
        raws = [n]
        for _ in range(order - 1):
            lower = Counter()
            for g, c in levels[-1].items():
                lower[g[1:]] += c > 0
            levels.append(dict(lower))
            raws.append(levels[-1])
        total = sum(levels[-1].values())
        p = {g: (c + 0.5) / (total + 0.5 * (len(levels[-1]) + 1)) for g, c in levels[-1].items()}
        for level, raw in zip(levels[-2::-1], raws[-2::-1], strict=True):
            n1, n2, n3, n4 = (max(1, sum(c == i for c in raw.values())) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [0.0, *(min(max(x, 0), most) for x, most in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.9)))]
            sums, off = Counter(), Counter()
            for g, c in level.items():
                sums[g[:-1]] += c
                off[g[:-1]] += d[min(c, 3)]
            q = {}
            for g, c in level.items():
                x = g[:-1]
                q[g] = (c - d[min(c, 3)]) / sums[x] + off[x] / sums[x] * p[g[1:]] if sums[x] else p[g[1:]]
            p = q
        for t, g in zip(mine, grams, strict=True):
            out[lang, t] = -sum(math.log(p[x]) for x in g) / len(g) if g else 0.0
    return out


@pytest.mark.parametrize("top", [1 << 21, 50])
def test_quality_rules_by_a_plain_model(spark, monkeypatch, top):
    from ruleweave.llm import kernels as K
    from ruleweave.llm import quality_rules as R

    monkeypatch.setattr(R, "TOP", top)  # with few grams sent to all tasks the others are joined
    r = random.Random(12)
    rows = [(i, x, prose(r, r.randint(15, 80)) if x != "zz" else " ".join(r.choice("日本語の文章です。") * 2 for _ in range(40))) for i in range(60) for x in [("en", None, "zz", "")[i % 4]]]
    rows += [(100, "en", "#!$ XQ" * 60), (101, "en", None), (102, None, ""), (103, "en", rows[0][2]), (103, "en", rows[0][2]), (None, "zz", "日" * 90), (104, "en", "ab cd " * (K.SLICE // 5)), (105, "én", "x y z")]
    docs = spark.createDataFrame([(d, t, x, 1.0) for d, x, t in rows], "doc_id long, text string, lang string, log_perplexity double").repartition(3)
    got = R.quality_rules(docs).collect()
    plain = kneser_ney([(x, t) for _, x, t in rows])
    expected = Counter((d, round(plain[x, t or ""], 4)) for d, x, t in rows)
    assert Counter((g.doc_id, round(g.log_perplexity, 4)) for g in got) == expected
    # the verdict: the median and the median deviation of those that pass the base rules
    lang, text = {d: x for d, x, _ in rows}, {d: t or "" for d, _, t in rows}
    bands = {}
    for x in set(lang.values()):
        values = sorted(g.log_perplexity for g in got if lang[g.doc_id] == x and not g.base_failed)
        if values:
            middle = values[(len(values) - 1) // 2]
            bands[x] = middle, sorted(abs(v - middle) for v in values)[(len(values) - 1) // 2]
    for g in got:
        middle, deviation = bands.get(lang[g.doc_id], (0, 0))
        wide = R.BAND * max(deviation, R.LEAST_DEVIATION) * (1 + R.SHORT / math.sqrt(max(len(text[g.doc_id]), 1)))
        assert g.kept == (not g.base_failed and abs(g.log_perplexity - middle) <= wide), g
    assert not next(g.kept for g in got if g.doc_id == 100)


def test_quality_rules_of_many_languages(spark):
    from ruleweave.llm.quality_rules import quality_rules

    # 230 languages, each with letters of its own and a document in another's letters
    rows = []
    for k in range(230):
        letters = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        r = random.Random(k)
        rows += [(10 * k + i, " ".join("".join(r.choices(letters, k=3)) for _ in range(40)), f"l{k}") for i in range(6)]
        rows.append((10 * k + 9, " ".join("".join(r.choices("abcdefghij", k=3)) for _ in range(40)), f"l{k}"))
    got = {g.doc_id: g.kept for g in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[d] for d, *_ in rows if d % 10 < 6) >= 0.97 * 230 * 6 and sum(got[10 * k + 9] for k in range(230)) <= 30


def test_sharding(docs, none):
    from ruleweave.llm.sharding import difference, shard_documents

    got = shard_documents(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for g in got:
        slots[g.shard].append(g.slot)
        groups[g.text_crc32, g.size].add(g.shard)
        assert g.law == "bytes" and g.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for k, s in groups.items() if k[1] > 1)
    assert shard_documents(none).count() == 0
    # two-way differencing of 8, 7, 6, 5, 4 leaves a spread of 2; loads of lists are their sums
    left, right = difference([([s, 0], [[s], []]) for s in (8, 7, 6, 5, 4)], 2)
    assert abs(sum(left) - sum(right)) == 2 and sorted(left + right) == [4, 5, 6, 7, 8]


def test_sharding_balances_bytes(spark, monkeypatch):
    from ruleweave.llm import sharding as S

    r = random.Random(6)
    sizes = [r.randint(1, 4000) for _ in range(3000)]
    rows = [(i, f"{i} " + "x" * n) for i, n in enumerate(sizes)] + [(None, "hot")] * 900 + [(9000 + i, "y" * 700) for i in range(40)] + [(1, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    for chunk in (50_000, 40):  # differenced at once, and by chunks whose partitions are differenced again
        monkeypatch.setattr(S, "CHUNK", chunk)
        got = S.shard_documents(docs).collect()
        load = Counter()
        for g in got:
            load[g.shard] += g.size
        assert len(got) == len(rows) and len(load) == 8
        # the smallest groups even out what the larger ones leave
        assert max(load.values()) - min(load.values()) <= 16, load
    parts = S.difference([([s, 0, 0], [[s], [], []]) for s in sorted(sizes[:60], reverse=True)], 3)
    loads = [sum(p) for p in parts]
    greedy = [0, 0, 0]
    for x in sorted(sizes[:60], reverse=True):
        greedy[greedy.index(min(greedy))] += x
    assert sorted(x for p in parts for x in p) == sorted(sizes[:60]) and max(loads) - min(loads) <= max(greedy) - min(greedy)


def test_mixing(spark, docs, none):
    from ruleweave.llm.mixing import poisson_count, replicate

    many = spark.range(60_000).withColumn("c", poisson_count(F.lit(1.7), F.col("id").cast("string"))).groupBy("c").count().collect()
    n = {r.c: r["count"] for r in many}
    mean = sum(k * v for k, v in n.items()) / 60_000
    assert mean == pytest.approx(1.7, abs=0.03) and n[0] / 60_000 == pytest.approx(np.exp(-1.7), abs=0.01)
    big = spark.range(3000).select(poisson_count(F.lit(30.0), F.col("id").cast("string")).alias("c")).agg(F.avg("c"), F.var_pop("c")).first()
    assert big[0] == pytest.approx(30, abs=0.5) and big[1] == pytest.approx(30, abs=3)
    src = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, null, if(id % 10 = 1, 'rare', 'hot')) as source", "1 as mix_order")
    out = replicate(src, {"rare": 0.5, "hot": 0.5}).groupBy("source").count().collect()
    assert {r.source: round(r["count"] / 1000) for r in out} == {"rare": 10, "hot": 10}
    again = replicate(docs)
    assert again.count() > 0 and set(docs.columns) <= set(again.columns)
    copies = again.groupBy("doc_id", "text").agg(F.collect_set("mix_copy").alias("k"), F.first("mix_count").alias("n")).collect()
    assert all(sorted(r.k) == list(range(r.n)) for r in copies)
    assert replicate(none).count() == 0


def test_differences_of_long_texts_dealt_in_steps(spark):
    """Digests are not looked at once for each sub-sketch: the plan deals them by two masks; all that differ are found."""
    from ruleweave.llm import fingerprints as P

    sql = P.differences_sql("a", "b", P.cells_sql("a", "7"), P.cells_sql("b", "7"))
    assert "p.coarse" in sql and "p.fine" in sql
    rows = spark.range(1).selectExpr("transform(sequence(1, 900), i -> xxhash64(i)) as a", "transform(sequence(300, 1300), i -> xxhash64(i)) as b")
    found = rows.selectExpr(f"{sql} as d").selectExpr("size(d) as n", "size(filter(d, t -> t.n = 1)) as a", "size(array_distinct(d)) as u").first()
    assert tuple(found) == (299 + 400, 299, 699)
