"""Each operator against brute force on small tables: nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mlode.llm import chat, common, decontam, jaccard, langid, mixing, quality, site_tree, substring, token_files, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, Quality int"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Über", "naïve", "x y", "#$", "|"]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = sentence(30)
    texts = [sentence(r.randint(1, 120)) for _ in range(n)]
    texts += [texts[1], texts[1] + " tail", "  " + texts[2].upper().replace(" ", "\n\n") + "\t", passage, sentence(40) + " " + passage + " " + sentence(5), passage + " " + sentence(60)]
    near = texts[5] + " " + sentence(80)
    for _ in range(6):
        w = near.split()
        w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [None, "", "   \n", "one", "a b c d", "a b c d", "a b c d e", " ".join(["loop"] * 50), sentence(4000), "é" * 5000]
    rows = [(k, t, None if k % 11 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, "c", 1) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4], "en", "s1", 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes_are_those_of_the_strings():
    texts = ["", "a  b", " lead", "trail ", None, "x y z", "a\x0bb\x1cc", "b a"]
    for _, _, data, offsets in common.text_chunks(pa.array(texts)):
        starts, ends, first = common.words(data, offsets)
        got = [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
        assert got == [w for t in texts for w in words(t)]
        assert np.diff(first).tolist() == [len(words(t)) for t in texts]
        hashes = common.span_hashes(data, starts, ends)
        assert len({*zip(got, hashes.tolist(), strict=True)}) == len(set(got)) == len(set(hashes.tolist()))


def test_jaccard_components(spark, docs, rows, none):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    own = {}
    for d, t, *_ in rows:
        own.setdefault(d, []).append(shingles(t))
    ids = [d for d in own if d is not None]
    comp = {d: d for d in ids}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in own[a] for y in own[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    want = sorted([(d, len(shingles(t)), None if d is None else find(d)) for d, t, *_ in rows], key=str)
    for limit in (jaccard.BLOCK_ROWS, 1):  # groups in one block, and dealt out in blocks
        before, jaccard.BLOCK_ROWS = jaccard.BLOCK_ROWS, limit
        try:
            assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == want
        finally:
            jaccard.BLOCK_ROWS = before
    assert jaccard.jaccard_components(none).count() == 0
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    assert kept == {d for d in ids if find(d) == d} | {None}


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"t{k}" for k in range(200)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(3):
            w[r.randrange(200)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    for k in range(20):  # far from the base, in pairs near each other
        w = texts[k // 2 * 3].split()
        for p in range(3, 200, 12):
            w[p] = f"p{k // 2}x{p}"
        if k % 2:
            w[r.randrange(200)] = f"odd{k}"
        texts[130 + k] = " ".join(w)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    comp = list(range(150))
    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert len(set(comp)) > 5
    for limit in (jaccard.BLOCK_ROWS, 20):
        before, jaccard.BLOCK_ROWS = jaccard.BLOCK_ROWS, limit
        try:
            assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == dict(enumerate(comp))
        finally:
            jaccard.BLOCK_ROWS = before


def test_one_id_with_different_texts_joins_their_components(spark):
    t = [" ".join(f"{a}{k}" for k in range(40)) for a in "uvw"]
    near = t[1].replace("v39", "end")
    rows = [(2, t[0]), (5, t[0]), (5, t[1]), (9, near), (11, t[2]), (12, None), (12, t[2]), (11, ""), (None, t[2])]
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()}
    assert got == {(2, 2), (5, 2), (9, 2), (11, 11), (12, 11), (None, None)}


def test_overlaps_are_the_matrix_product():
    r = np.random.default_rng(4)
    for n, m in ((5, 7), (70, 3), (40, 90)):
        sets = [np.unique(r.integers(0, 400, r.integers(1, 60)).astype(np.uint64)) for _ in range(n + m)]
        sets += [np.unique(np.append(r.integers(400, 10**6, 20).astype(np.uint64), np.uint64(7))) for _ in range(5)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (jaccard.overlaps(sets, None) == want).all() and (jaccard.overlaps(sets[:n], sets[n:]) == want[:n, n:]).all()
        link = want >= 3
        for both, part in ((True, link), (False, link[:n, n:])):
            size = len(sets)
            comp, found = list(range(size)), list(range(size))

            def join(c, x, y):
                return [c[x] if k == c[y] else k for k in c]

            for x, y in zip(*np.nonzero(part), strict=True):
                comp = join(comp, x, y if both else y + n)
            pairs = jaccard.spanning(part, both)
            for x, y in pairs:
                assert part[x, y]
                found = join(found, x, y if both else y + n)
            assert len(pairs) < size and len({*zip(comp, found, strict=True)}) == len(set(comp)) == len(set(found))


def thue_morse(k):
    """Two words of 2**k letters that agree under every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_under_polynomial_hashes(spark):
    u, v = thue_morse(11)
    tail = " ".join(f"t{k}" for k in range(12))
    rows = [(1, f"{u} {tail}"), (2, f"{v} {tail}"), (3, f"{u}\n{v}\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(df).orderBy("doc_id").collect()] == [0, 0, 0]
    assert quality.judge(df, None).orderBy("doc_id").select("quality.n_dup_lines").collect()[2][0] == 0
    short = spark.createDataFrame([(1, u), (2, v), (3, u + " a b c d"), (4, v + " a b c d")], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.jaccard_components(short).orderBy("doc_id").collect()] == [1, 2, 3, 4]


def test_substring_dedup(spark, docs, rows, none):
    first = {}
    for d, t, *_ in rows:
        w, key = words(t), substring.LAST_ID if d is None else d
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, key), key)
    want = []
    for d, t, *_ in rows:
        w, key, gone = words(t), substring.LAST_ID if d is None else d, set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), kept))
    got = [tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[2] for x in want)
    before, substring.BUCKET_BYTES = substring.BUCKET_BYTES, 4000  # more buckets than partitions
    try:
        got = [tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    finally:
        substring.BUCKET_BYTES = before
    assert sorted(got, key=str) == sorted(want, key=str)
    digests = {r["kept_sha256"] for r in substring.remove_repeats(docs, only_digest=True).collect()}
    assert digests == {hashlib.sha256(x[3].encode()).hexdigest() for x in want}
    assert substring.remove_repeats(none).count() == 0


def test_quality_rules(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(3, 1, 0), (None, 1, 0), (50, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels, out="judged").select("doc_id", "text", "copy", "Quality", "judged.*").collect()
    assert len(got) == len(rows)
    for r in got:
        t, w = r["text"] or "", words(r["text"])
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = set()
        for k, g in enumerate(windows):
            if windows.count(g) > 1 if len(windows) < 500 else False:
                cover |= set(range(k, k + 5))
        lines, seen = 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines)
        if len(windows) < 500:
            assert r["n_repeat_words"] == len(cover)
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    assert all(r["score"] == 0 for r in quality.quality_rules(docs, labels.limit(0)).select("quality.score").collect())
    assert quality.quality_rules(none, labels).count() == 0
    lined = spark.createDataFrame([(1, "a b\nc\n\na b\n \nc\na b"), (2, "x"), (3, "x\nx")], "doc_id long, text string")
    assert [r["n_dup_lines"] for r in quality.judge(lined, None).orderBy("doc_id").select("quality.n_dup_lines").collect()] == [3, 0, 1]


def test_quality_model_is_the_ratio(spark):
    df = spark.createDataFrame([(1, "good words here"), (2, "bad junk"), (3, "bad junk")], "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), buckets=1 << 12, prior=1.0)
    (_, _, data, offsets), = common.text_chunks(pa.array(["good junk"]))
    starts, ends, _ = common.words(data, offsets)
    at = (common.span_hashes(data, starts, ends) & np.uint64((1 << 12) - 1)).astype(int)
    # raw: 5 + 3 + 3 grams, target 5
    assert np.allclose(model[at], np.log([(1 + 1) / (1 * 5 / 11 + 1), (0 + 1) / (2 * 5 / 11 + 1)]))


def test_language_model_code_lengths():
    """Exact PPM code lengths, recomputed from counts."""
    texts = {"aa": [b"abab abba", b"ba"], "bb": [b"zzzz yz", "ÿüÿ 5".encode()], "cc": [bytes(range(256)) * 3]}
    model = langid.Model(["aa", "bb", "cc"], texts)
    for probe in (b"abz q", b"b", b"", "ÿüÿÿ 9Z".encode(), bytes(range(255, -1, -1))):
        out = model.bits(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0]
        for i, lang in enumerate(model.langs):
            counts = {}
            for t in texts[lang]:
                s = [0] * langid.DEPTH + [int(model.map[b]) for b in t]
                for k in range(langid.DEPTH, len(s)):
                    for order in range(langid.DEPTH + 1):
                        counts.setdefault((order, tuple(s[k - order : k])), {}).setdefault(s[k], 0)
                        counts[order, tuple(s[k - order : k])][s[k]] += 1
            bits, s = 0.0, [0] * langid.DEPTH + [int(model.map[b]) for b in probe]
            for k in range(langid.DEPTH, len(s)):
                for order in range(langid.DEPTH, -1, -1):
                    seen = counts.get((order, tuple(s[k - order : k])))
                    if seen is None:
                        continue
                    n, q = sum(seen.values()), len(seen)
                    if s[k] in seen:
                        bits -= np.log2(seen[s[k]] / (n + q))
                        break
                    bits -= np.log2(q / (n + q))
                else:
                    bits += np.log2(langid.SYMBOLS)
            assert abs(bits - out[i]) < 1e-3 * max(1, bits)


def test_places_of_keys():
    r = np.random.default_rng(2)
    for n in (0, 1, 50, 40_000):
        keys = np.unique(r.integers(0, 1 << 32, n, np.uint64)).astype(np.uint32)
        sought = np.concatenate([keys, r.integers(0, 1 << 32, 1000, np.uint64).astype(np.uint32)])
        place = {int(k): i for i, k in enumerate(keys)}
        assert langid.Keys(keys).find(sought).tolist() == [place.get(int(k), -1) for k in sought]


def test_language_queries(spark, docs, rows, none):
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items() if d is not None) and held[None] is False
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for d, t, *_ in rows:
        if d is not None:
            assert (by[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert all(0 <= r["score"] <= 1 for r in got)
    marks = spark.createDataFrame([(1, "½ ² Ⅷ 12"), (2, "ª"), (3, "漢"), (4, "_ 7 !"), (5, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(marks, langid.fit(docs)).orderBy("doc_id").collect()] == [True, False, False, True, False]
    again = spark.createDataFrame([(1, f"text {k} of one id", "xx") for k in range(50)] + [(k, "w" * 30_000, "yy") for k in (4, 5, 6)], "doc_id long, text string, lang string")
    assert langid.fit(again).langs == ["xx", "yy"]
    assert langid.fit(none) is None and langid.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = langid.op2_ppm_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_token_files(spark, docs, rows, none, tmp_path):
    path = token_files.default_tokenizer()
    tokenizer = token_files.encoder(path).tokenizer
    special = [(1000, "Hi<|endoftext|>. <|ENDOFTEXT|> it's 5.,", None, None, None, None, None), (1001, "ÉCOLE. don't,", None, None, None, None, None)]
    df = docs.unionByName(spark.createDataFrame(special, SCHEMA))
    files = token_files.write_token_files(df, path, f"file://{tmp_path}/t")
    got = sorted(map(tuple, token_files.read_token_files(spark, files).collect()), key=lambda r: r[1])
    want, at = [], 0
    ids_of = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    every = [(d, ids_of(t)) for d, t, *_ in rows + special]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((d, len(i), zlib.crc32(np.array(i, "<u4"))) for d, i in every), key=str)
    for d, start, n, _ in got:
        assert start == at
        at += n
        want.append(d)
    assert want == sorted(want, key=lambda d: (d is not None, d or 0))
    some = token_files.read_token_files(spark, files, {3, 1000}).collect()
    assert {r["doc_id"] for r in some} == {3, 1000}
    reader = token_files.FileReader(files[-1]["file"])
    raw = open(files[-1]["file"].removeprefix("file://"), "rb").read()
    broken = tmp_path / "broken.zst"
    broken.write_bytes(bytes([raw[0]]) + raw[1:20] + bytes([raw[20] ^ 255]) + raw[21:])
    with pytest.raises(Exception):
        list(token_files.FileReader(f"file://{broken}").documents())
    assert reader.counts.sum() == files[-1]["n_tokens"]
    assert token_files.tokenize(none).count() == 0


def test_mixing(spark, docs, rows, none):
    got = mixing.mix_sources(docs, weights={"s0": 3.0, None: 1.0})
    assert {r["source"] for r in got.collect()} <= {"s0", None}
    assert "copy" in got.columns and got.columns.count("copy") == 1
    assert mixing.mix_sources(none).count() == 0
    assert [tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "copy").collect()] == [tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "copy").collect()]
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    for rate in (0.3, 5.0, 700.0):
        counts = many.limit(2000 if rate > 100 else 20000).withColumn("n", mixing.poisson_count(lambda part: common.id_hash(F.lit(1), F.col("doc_id"), part), F.lit(rate))).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
        assert abs(counts["m"] / rate - 1) < 0.05 and abs(counts["v"] / rate - 1) < 0.12


def test_decontamination(spark, docs, rows, none):
    texts = {d: t for d, t, *_ in rows if d is not None}
    long = [t for t in texts.values() if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].split()[20:60]).upper()), (2, "not here at all my friend of old times"), (3, None), (4, ""), (5, "a b c"), (6, " ".join(long[1].split()[5:30] + ["new"] * 3)), (None, "one"), (1, " ".join(long[0].split()[20:60]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(text, n):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}, len(w)

    want = set()
    for d, t, *_ in rows:
        for i, s in items:
            n = min(5, shingles(s, 1)[1])
            if n:
                own, there = shingles(s, n)[0], shingles(t, n)[0]
                if len(own & there) >= 0.75 * len(own):
                    want.add((d, i))
    for limit in (decontam.MOST_SENT, 0):  # a set of hashes and candidates, and joins
        before = decontam.MOST_SENT, decontam.MOST_CANDIDATES
        decontam.MOST_SENT = decontam.MOST_CANDIDATES = limit
        try:
            got = [(r["doc_id"], r["item_id"]) for r in decontam.find_contained(docs, bench).collect()]
        finally:
            decontam.MOST_SENT, decontam.MOST_CANDIDATES = before
        assert sorted(set(got), key=str) == sorted(want, key=str)
        assert any(i == 1 for _, i in got) and len(got) == len(set(got))
    assert decontam.find_contained(none, bench).count() == 0 and decontam.find_contained(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_null_ids_by_both_paths(spark):
    r = random.Random(8)
    text = lambda n: " ".join(f"v{r.randrange(500)}" for _ in range(n))
    a, b = text(30), text(30)
    docs = spark.createDataFrame([(1, text(20) + " " + a), (None, a + " " + text(9)), (None, text(9) + " " + b), (2, text(50)), (1, b), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, a), (None, b), (None, "v1"), (8, text(30)), (None, None)], "item_id long, text string")
    found = []
    for limit in (decontam.MOST_SENT, 0):
        before, decontam.MOST_SENT = decontam.MOST_SENT, limit
        try:
            found.append(sorted(map(tuple, decontam.find_contained(docs, bench).collect()), key=str))
        finally:
            decontam.MOST_SENT = before
    assert found[0] == found[1]
    assert {(1, 7), (None, 7), (1, None), (None, None)} <= {x[:2] for x in found[1]}


def test_the_size_partition_sets_the_sketch(spark):
    bench = spark.createDataFrame([(s, " ".join(f"v{k}" for k in range(s + 4))) for s in (1, 3, 4, 7, 8, 9, 40)], "item_id long, text string")
    got = {r["_item"]: (r["_s"], r["_part"], len(r["_sketch"]), r["_hits"], r["_least"]) for r in decontam.item_sketches(bench, "item_id", "text", 5, 0.75).collect()}
    assert got == {1: (1, 0, 1, 1, 1), 3: (3, 1, 3, 3, 2), 4: (4, 2, 4, 3, 3), 7: (7, 2, 5, 4, 3), 8: (8, 3, 7, 5, 6), 9: (9, 3, 7, 5, 6), 40: (40, 5, 19, 9, 24)}


def test_chat(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "Bob B", None), (2, 0, None, "x"), (2, None, "user", "y"), (2, 0, None, "x"), (None, 1, "user", "lost"), (3, 300, "user", "far"), (3, 1, "user", "near")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    got = {(r["conv_id"], r["perspective"], r["block"]): r for r in chat.assemble(chat.rotate(df)).collect()}
    assert set(got) == {(1, "user", 0), (1, "assistant", 0), (1, "Bob B", 0), (2, "unknown", 0), (2, "unknown", -1), (2, "user", 0), (2, "user", -1), (None, "user", 0), (3, "user", 0), (3, "user", 1)}
    r = got[1, "user", 0]
    assert r["rendered"] == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=assistant\nhello<|im_end|>\n<|im_start|>user name=Bob_B\n<|im_end|>\n"
    (a, b), = [map(int, x.split(":")) for x in r["mask"].split(",")]
    assert r["rendered"][a:b] == "hi"
    assert got[2, "unknown", 0]["n_target_turns"] == 2
    for hot, sent in ((2, 100), (2, 0)):  # long dialogues are salted, by a list that is sent or joined
        before = chat.HOT_TURNS, chat.MOST_SENT
        chat.HOT_TURNS, chat.MOST_SENT = hot, sent
        try:
            again = {(x["conv_id"], x["perspective"], x["block"]): x for x in chat.assemble(chat.rotate(df)).collect()}
        finally:
            chat.HOT_TURNS, chat.MOST_SENT = before
        assert again == got
    assert chat.assemble(chat.rotate(df.limit(0))).count() == 0


def test_warc(spark, tmp_path):
    page = "<p>" + "z" * 200 + "é</p>"
    rows = [(1, "http://www.B.example.com/x?y", page), (2, "http://a.example.com/", page), (0, None, "short"), (5, "https://c.d/ e\n", "short"), (6, None, None), (None, "http://a.example.com/", page), (1, "http://again/", page), (9, "http://a.example.com/", "other " * 40)]
    rows += [(20, "http://[x\ny", "q" * 120), (21, "http://h:port/ z", "q" * 120), (22, "http://e/", "r" * 150), (22, "http://e/", "r" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    want = []
    for d, _, h in rows:
        raw = (h or "").encode()
        same = [x for x, _, y in rows if (y or "") == (h or "") and x is not None]
        first = min(same) if len(raw) >= 100 and sum((y or "") == (h or "") for _, _, y in rows) > 1 else None
        again = first is not None and first != d
        want.append((d, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    for limit in (warc.MOST_SENT, 0):  # digests sent, and joined
        before, warc.MOST_SENT = warc.MOST_SENT, limit
        try:
            ranges = warc.archive(df.repartition(2), f"file://{tmp_path}/w{limit}")
            assert sorted(map(tuple, warc.read_archives(df, ranges).collect()), key=str) == sorted(want, key=str)
        finally:
            warc.MOST_SENT = before
    index = warc.CaptureIndex(ranges)
    found = index.lookup("http://a.example.com/")
    assert sorted(x["WARC-Type"] for x in found) == ["response", "revisit", "revisit"]
    assert any(x["payload"] == b"other " * 40 for x in found) and index.lookup("http://nowhere/") == []
    assert len(index.lookup("http://[x\ny")) == len(index.lookup("http://h:port/ z")) == 1
    every = [x for u in {u for _, u, _ in rows} for x in index.lookup(u or "")]
    assert len(every) == len(rows) == len({x["WARC-Record-ID"] for x in every})
    (revisit,) = [x for x in every if x["X-Page-Id"] == "21"]
    (response,) = [x for x in every if x["X-Page-Id"] == "20"]
    assert revisit["WARC-Refers-To"] == response["WARC-Record-ID"]
    assert warc.url_key("http://www.B.example.com:80/x?y#z") == "com,example,b,www:80)/x?y"
    assert warc.read_archives(df, warc.archive(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_index_finds_every_url(spark, tmp_path):
    """Keys with blanks, marks that sort around them, fragments, newlines and urls that can't be split, over several ranges and blocks; a key with more captures than a block."""
    urls = [f"http://s{k % 3}.org/b{mark}{k}" for k in range(700) for mark in (" ", "!", "#", "%20", "\n", "$")]
    urls += [f"http://[bad {k}\n" for k in range(50)] + ["http://hot.org/"] * 3000 + [None] * 5
    df = spark.createDataFrame([(k, u, f"p{k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = warc.archive(df.repartition(3), f"file://{tmp_path}/i")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1
    got = warc.read_archives(df, ranges).select("page_id").collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
    index, keys = warc.CaptureIndex(ranges), {}
    for k, u in enumerate(urls):
        keys.setdefault(warc.url_key(u), []).append(k)
    for k in [*range(0, 4200, 41), 4201, 4250, len(urls) - 1]:
        assert sorted(int(x["X-Page-Id"]) for x in index.lookup(urls[k])) == keys[warc.url_key(urls[k])]


def test_site_tree(spark):
    def page(k, host):
        body = f"<h1>Title {k}</h1><p>Text {k} &amp; more<b>bold</b> of {k * 7}<br>line</p><p>Second<ul><li>one {k}<li>two</ul>" + "<div class=x>Share this page</div>"
        return (k, f"http://{host}/{k}", f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><div class='wrap'><div class='tag'>Site slogan</div><div class='text'>{body}</div></div><div class='comment'>nice {k}</div><form>q</form><footer>&copy; {k}</footer></body></html>")

    rows = [page(k, "big.org") for k in range(60)] + [page(100 + k, f"h{k}.org") for k in range(3)] + [(200, None, None), (201, "x", ""), (202, "http://big.org/z", "plain <!-- open"), (None, "http://big.org/1", "<article><header>Head</header><p>In</article>out")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in site_tree.extract(df.repartition(3)).collect()}
    for k in (5, 101):
        assert got[k]["text"] == f"Title {k} Text {k} & morebold of {k * 7} line Second one {k} two"
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[200]["text"] == got[201]["text"] == "" and got[202]["text"] == "plain" and got[None]["text"] == "Head In"
    before, site_tree.MOST_SENT = site_tree.MOST_SENT, 0
    try:
        joined = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    finally:
        site_tree.MOST_SENT = before
    assert joined[5] == got[5]["text"]
    assert site_tree.extract(df.limit(0)).count() == 0


def test_site_tree_importances_are_those_of_the_merged_pages(spark):
    """Entropies and their composition, recomputed page by page."""
    r = random.Random(11)
    rows = []
    for k in range(45):
        items = "".join(f"<li>{r.choice(('a', 'b', k))}</li>" for _ in range(r.randint(0, 4)))
        rows.append((k, f"http://{r.choice('xy')}.org/{k}", f"<body>top<div class='w {r.choice(('p', 'q'))}'><h1>T {k}</h1><ul>{items}</ul><p>{r.choice(('same', k))}</p><p>more {k}</p></div><div class='s'>Slogan</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * np.log(c / n) for c in counts.values()) / np.log(n) if n > 1 else 1.0

    want = {}
    for host in "xy":
        looks, texts, below = {}, {}, {}
        for _, url, page in rows:
            if url[7] == host:
                found, nodes = site_tree.blocks(page)
                for node in nodes:
                    kids = [x.path for x in node.kids] + [node.path + ">#text" for b, _ in found if b is node]
                    looks.setdefault(node.path, []).append(tuple(x.path for x in node.kids))
                    below.setdefault(node.path, []).append(kids)
                for block, text in found:
                    texts.setdefault(block.path + ">#text", []).append(text)

        def importance(path):
            if path in texts:
                c = {}
                for t in texts[path]:
                    c[t] = c.get(t, 0) + 1
                return entropy(c)
            c = {}
            for t in looks[path]:
                c[t] = c.get(t, 0) + 1
            w = site_tree.GAMMA ** (sum(map(len, below[path])) / len(below[path]))
            return (1 - w) * entropy(c) + w * sum(sum(map(importance, k)) / len(k) for k in below[path] if k) / len(below[path])

        for path in [*texts, *looks]:
            n = len(texts.get(path) or looks[path])
            want[site_tree.site_of(f"http://{host}.org/"), site_tree._hash(path)] = (n, importance(path))
    counts = site_tree.features(df.repartition(3))
    got = {(x["site"], x["node"]): x for x in site_tree.importances(counts.groupBy("site", "node", "depth", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("share").alias("share")), 5).collect()}
    assert set(got) == set(want)
    for k, (n, value) in want.items():
        assert got[k]["instances"] == n and abs(got[k]["importance"] - value) < 1e-9
    for (site, node), x in got.items():  # a branch's score is the largest judged importance in it
        assert x["score"] is None or x["instances"] < 5 or x["score"] >= x["importance"] - 1e-12


def test_class_words_that_name_a_state_or_hold_the_article(spark):
    text = lambda html: site_tree.main_text(html, {})
    story = "<h1>Head</h1><p>Body text of the story.</p>"
    for html in (
        f"<article class='post comments-open'>{story}</article>", f"<div class='layout has-sidebar'><article>{story}</article></div>", f"<main data-id='ad'>{story}</main>", f"<div class='no-ad'>{story}</div>",
        f"<div class='sidebar-layout'><main>{story}</main><aside>x</aside></div>", f"<div role='main' class='related'>{story}</div>", f"<nav>Menu</nav><div class='widget'>{story}</div>",
        f"<a title=\"{'x' * 4100}> leak\">.</a>".replace(">.<", "><") + story, f"<article>{story}</article><div class='reader-comments'><article class='comment-body'>Nice!</article></div>",
        f"<article>{story}</article><div class='related'><article>Teaser of another page</article></div>", f"<div class='cookie-banner'>We use</div><div id='site-nav'>Menu</div>{story}<div class='ad-slot'>Buy</div>", story + "<a href=x",
    ):
        assert text(html) == "Head Body text of the story.", html
    assert text(f"<article>Teaser</article><div class='text'>{story * 3}</div>").count("Body text") == 3
    assert text("<!-- a > b" + story) == "" and text("x <script>var a = 1 > 0;") == "x" and text("a < b") == "a < b"


def test_site_tree_beyond_what_is_sent(spark):
    """Pages of small hosts lose the repeated blocks of all pages, however many low nodes there are."""

    def page(k, host):
        return (k, f"http://{host}/{k}", f"<body><div class='wrap'><div class='slogan'>Site slogan</div><div class='text'><p>Text {k} of {k * 7}</p></div><div class='x'>Share this page</div></div></body>")

    small = [page(k, f"h{k % 20}.org") for k in range(60)]
    small += [small[0], (None, "http://h1.org/", small[1][2]), (98, None, None), (99, "http://h2.org/", "")]
    for rows in (small, small + [page(100 + k, "big.org") for k in range(40)]):  # without and with a host that has a tree of its own
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        got = []
        for limit in (site_tree.MOST_SENT, 0):
            before, site_tree.MOST_SENT = site_tree.MOST_SENT, limit
            try:
                got.append(sorted(map(tuple, site_tree.extract(df).collect()), key=str))
            finally:
                site_tree.MOST_SENT = before
        assert got[0] == got[1] and len(got[0]) == len(rows)
        assert all(text == f"Text {k} of {k * 7}" for k, _, text, _ in got[1] if k is not None and k not in (98, 99))


def brute_quality(rows, good):
    """The rows that the quality rules keep: n-gram counts in dictionaries, scores as sums."""

    def grams(text):
        out = []
        for _, _, data, offsets in common.text_chunks(pa.array([text or ""])):
            starts, ends, _ = common.words(data, offsets)
            h = common.span_hashes(data, starts, ends)
            out = [int(x) % quality.BUCKETS for x in h] + [int(x) % quality.BUCKETS for x in common.gram_hashes(h, 2)]
        return out

    raw, target = {}, {}
    for d, t, *_ in rows:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (d in good)
    share = sum(target.values()) / sum(raw.values())
    kept = []
    for row in rows:
        w, gs = words(row[1]), grams(row[1])
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = {}
        for g in windows:
            seen[g] = seen.get(g, 0) + 1
        cover = {k + i for k, g in enumerate(windows) if seen[g] > 1 for i in range(5)}
        score = sum(np.log((target[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR)) for g in gs) / max(1, len(gs))
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w) and score >= quality.THRESHOLD:
            kept.append(row)
    return kept


def brute_one_of_each(rows):
    """The rows whose id is the smallest of its near-duplicate group."""
    sets = {}
    for d, t, *_ in rows:
        w = words((t or "").lower()) if (t or "").isascii() else words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets.setdefault(d, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = sorted(d for d in sets if d is not None)
    comp = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    return [r for r in rows if r[0] is None or comp[r[0]] == r[0]]


def brute_clean(rows, items):
    def shingles(text, n):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}, len(w)

    def leaks(text):
        for _, s in items:
            n = min(5, shingles(s, 1)[1])
            if n and 4 * len(shingles(s, n)[0] & shingles(text, n)[0]) >= 3 * len(shingles(s, n)[0]):
                return True
        return False

    gone = {r[0] for r in rows if leaks(r[1])}
    return [r for r in rows if r[0] is None or r[0] not in gone]


def brute_mix(rows):
    n = {}
    for r in rows:
        n[r[3]] = n.get(r[3], 0) + 1
    total = sum(v**mixing.TEMPERATURE for v in n.values())
    out = []
    for r in rows:
        rate = n[r[3]] ** mixing.TEMPERATURE / total * len(rows) / n[r[3]]
        u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, np.exp(-rate)
        f = p
        while f < u:
            k += 1
            p *= rate / k
            f += p
        out += [r] * k
    return out


def test_pipeline(spark, docs, rows, none, tmp_path):
    """Every stage's rows, and the last one's table, against brute force."""
    import corpus_pipeline as P

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    long = [t for _, t, *_ in rows if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].split()[20:60])), (2, "none of these words is there at all"), (3, None)]
    mine = docs.select(names).coalesce(1)
    mine.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = [lambda x: brute_quality(x, set(range(40))), brute_one_of_each, lambda x: brute_clean(x, items), brute_mix]
    want, df = [r[:5] for r in rows], mine
    for (name, stage), brute in zip(P.STAGES[:-1], steps, strict=True):
        before, want = len(want), brute(want)
        df = common.written(stage(spark, df, str(tmp_path)), name)
        assert df.columns == names and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str), name
        assert 10 < len(want) != before, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    tokenizer = token_files.encoder(token_files.default_tokenizer()).tokenizer
    at, table = 0, []
    for d, t, *_ in sorted(want, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        table.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, out.collect()), key=lambda r: r[1]) == table
