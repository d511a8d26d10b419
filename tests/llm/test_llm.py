"""Corpus operators against brute force and on awkward tables."""

import collections
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from meetspark.llm import decontaminate, html_text, language_id, licenses, line_dedup, packing, quality, simhash, substring_dedup, tokens, toxicity, words
from meetspark.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
NASTY = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b a b a b"), (None, "no id here"), (6, LONG), (7, LONG), (8, "same"), (8, "same"), (8, "other text"), (9, "x\n\nx\n"), (10, "é ü — ∑")]


def docs(spark, rows=NASTY):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def clashing(df):
    """Extra columns that carry names used inside the operators."""
    return df.selectExpr("*", *(f"cast(NULL AS string) AS {c}" for c in ("id", "row", "anchor", "path", "print", "uid", "words", "n", "h", "at", "x", "queue", "begin", "component", "trusted", "score")))


BENCH = [(1, " ".join(f"w{i}" for i in range(20))), (2, "A b"), (3, None), (4, "")]
APPLY = {
    "op1": lambda s, d: substring_dedup.substring_dedup(d),
    "op2": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame(BENCH, "item_id long, text string")),
    "op3": lambda s, d: simhash.simhash_groups(d),
    "op6": lambda s, d: quality.quality(d, d.filter("doc_id = 6")),
    "op7": lambda s, d: packing.pack(d),
    "op8": lambda s, d: licenses.scan_licenses(d),
    "op9": lambda s, d: toxicity.toxicity(d, s.createDataFrame([(6, 1, 1), (7, 0, 0), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")),
    "op10": lambda s, d: line_dedup.line_dedup(d),
}


@pytest.mark.parametrize("op", APPLY)
def test_awkward_rows_and_empty_tables(spark, op):
    rows = APPLY[op](spark, clashing(docs(spark))).collect()
    got = collections.Counter(r.doc_id for r in rows)
    want = collections.Counter(i for i, _ in NASTY)
    assert got.keys() == want.keys() if op == "op7" else got == want
    assert APPLY[op](spark, docs(spark).limit(0)).collect() == []


def random_docs(seed=1, n=40):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        words = sum((rng.choice(pool) for _ in range(rng.randint(0, 4))), [])
        words = [w if rng.random() > 0.01 else "zz" for w in words]
        out.append((i * 3, re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+) ", r"\1\n", " ".join(words))))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    rows = random_docs() + [(200 + i, " ".join(["a"] * rng.randint(0, 90) + ["x"] * (i % 2) + ["b", "c"] * rng.randint(0, 60) + ["a"] * rng.randint(0, 70))) for i in range(12)]
    for window, k in ((50, 12), (8, 3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs(spark, rows), window, k).collect()}
        first = {}
        for i, t in sorted(rows):
            w = t.split()
            for j in range(len(w) - window + 1):
                first.setdefault(tuple(w[j : j + window]), i)
        for i, t in rows:
            w, gone = t.split(), set()
            for j in range(len(w) - window + 1):
                if first[tuple(w[j : j + window])] < i:
                    gone.update(range(j, j + window))
            assert got[i] == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))


@pytest.mark.parametrize("most_bits", [1 << 23, 64])
def test_decontaminate_equals_brute_force(spark, most_bits):
    rows = random_docs(2)
    bench = [(1, " ".join(rows[5][1].split()[3:30])), (2, rows[7][1].upper()[:60]), (3, "a1, A2"), (4, "..."), (11, None), (12, " ".join(rows[5][1].split()[3:15]))]
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), most_bits=most_bits).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = word.findall((t or "").lower())
        for j in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    for i, t in rows:
        w, hit, items = word.findall(t.lower()), set(), set()
        for key, ids in windows.items():
            for j in range(len(w) - len(key) + 1):
                if tuple(w[j : j + len(key)]) == key:
                    hit.update(range(j, j + len(key)))
                    items |= ids
        assert got[i] == (len(w), len(hit), sorted(items))


def test_simhash_equals_brute_force(spark):
    rows = random_docs(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    prints = {}
    for i, t in rows:
        w = t.lower().encode().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_ball_links_and_components_of_a_chain(spark):
    chain = [0]
    for i in range(20):
        chain.append(chain[-1] ^ (3 << (2 * i)))
    prints = spark.createDataFrame([(x,) for x in chain] + [(7 << 60,), (-1,)], "print long")
    found = {r.node: r.component for r in components(simhash.links(prints)).collect()}
    assert found == dict.fromkeys(chain, 0)


def test_packing_round_trip_and_shares(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["hello", "world", "it's", "ünï", "x9"]) for _ in range(rng.randint(0, 900))), "en", f"s{i % 3}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    encoder = packing.encoder_of(packing.VOCABULARY, packing.END_ID)
    for weights in (None, {"s0": 3.0}):
        pieces, places = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(df, 256, weights, 16).collect():
            pieces[r.doc_id].append(r)
            places[r.sequence_id].append((r.offset, r.length, r.source))
        for i, t, *_ in rows:
            ids, at = encoder.encode(next(words.blocks(pa.array([t]))))[0].astype("<u4"), 0
            assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1]
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
                at += r.length
            assert at == len(ids)
        for s, found in places.items():
            at = 0
            for offset, length, _ in sorted(found):
                assert offset == at
                at += length
            assert at == 256 or s == max(places)
        if weights:
            first = sum(n for _, n, q in places[1] if q == "s0")
            assert 110 <= first <= 196  # three fifths of 256, give or take a quantum of each queue


def test_tokens_equal_those_of_whole_texts():
    """Units of odd characters, special tokens' strings, long words and digits against the tokenizer itself."""
    rng = random.Random(13)
    signs = [*"aAbBzZ'sStTreRE lLmM019.,-_;!?()<>|/\t\n éÉßÞ×÷Ñ½²Ⅳé中文 \u00a0\u3000\x00\x1c—…", "\u0301", "\u0338", "H\u0331", "İ", "Σ", "'s", "'ll", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["", None, "a" * 10_000, "é'" * 500, "1" * 300]
    encoder = tokens.Encoder(packing.VOCABULARY, packing.END_ID, most=2_000)
    got = []
    for b in words.blocks(pa.array(texts, pa.string()), block_bytes=1 << 14):
        ids, n = encoder.encode(b)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]


def test_line_dedup_equals_brute_force(spark):
    rows = random_docs(5) + [(1000, "p q r s t\np q r s u\nv p q r s t\nq r s t\na b\na c\n\na b")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    seen = []
    for i, t in sorted(rows):
        kept, lines = [], t.split("\n")
        for line in lines:
            w = line.split()
            if w and any(o == w or min(len(w), len(o)) >= 5 and near(w, o) for o in seen):
                pass
            else:
                kept.append(line)
            if w:
                seen.append(w)
        assert got[i] == (len(lines) - len(kept), "\n".join(kept))


def test_line_dedup_of_very_long_lines(spark):
    """Two lines of 60,000 words that differ in one of them, and a third that lacks one: linear, and found."""
    rng = random.Random(14)
    line = [f"w{rng.randint(0, 9999)}" for _ in range(60_000)]
    other, shorter, far = list(line), line[:40_000] + line[40_001:], list(line)
    other[31_234] = "changed"
    far[5], far[50_000] = "one", "two"
    rows = [(i, " ".join(x)) for i, x in enumerate((line, other, shorter, far))]
    assert [r.n_removed for r in line_dedup.line_dedup(docs(spark, rows)).orderBy("doc_id").collect()] == [0, 1, 1, 0]


def test_licenses_find_phrases_and_templates(spark):
    text = "x\nLicensed under the Apache License, Version 2.0.\nCC-BY and cc by-nc"
    r = licenses.scan_licenses(docs(spark, [(1, text), (2, "apache licenses"), (3, "Subject to terms of the Mozilla Public License version 2.0 only")])).orderBy("doc_id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (3, 4, 12, "apache,cc-by")
    assert "apache-2.0" in r[0].labels.split(",") and r[1].labels == "" and r[1].score == 0 and r[2].base_labels == "" and r[2].labels == "mpl-2.0"


def test_licenses_of_several_families_and_wrapped_notices(spark):
    both = "Licensed under the Apache License 2.0 or released under the MIT License"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software), to deal"
    gpl = "x\nLicensed under the GNU\nGeneral Public\n\nLicense, version 2\ny"
    rows = [(1, both), (2, mit), (3, gpl), (4, "Licensed under the BSD 2 clause license"), (5, "released under" + " v" * 30 + "\nthe license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[1].labels == "apache,apache-2.0,mit"
    assert got[2].labels == "mit" and got[2].score == 1 and set(got[3].labels.split(",")) == {"gpl", "gpl-2.0"}
    assert got[4].labels == "bsd-2-clause" and got[5].labels == ""


def test_license_filters_drop_candidates_and_lose_no_pair(spark):
    """The positional filter leaves fewer pairs, and what passes and is verified equals all pairs by plain loops."""
    rng = random.Random(17)
    sets = licenses.template_sets(licenses.TEMPLATES)
    some = sorted({w for _, words in sets for w in words})
    texts = {i: [rng.choice([*some, "plain", "other"]) for _ in range(rng.randint(4, 14))] for i in range(150)}
    texts |= {150 + i: rng.sample(words, max(1, len(words) - i % 4)) for i, (_, words) in enumerate(sets * 4)}
    blocks = spark.createDataFrame([(i, False, 0, sorted(set(w))) for i, w in texts.items()], "uid long, wrapped boolean, line int, block array<string>")
    order = licenses.ordered_vocabulary(blocks.select(F.col("block").alias("words")), licenses.TEMPLATES)
    prefixes = licenses.template_prefixes(order, licenses.TEMPLATES, licenses.THRESHOLD)
    every = licenses.candidates(blocks, order, prefixes, positional=False)
    left = licenses.candidates(blocks, order, prefixes)
    assert left.count() < every.count()
    got = {(r.uid, r.label) for r in left.filter(F.size(F.array_intersect("ranks", "words")) >= F.col("needed")).collect()}
    assert got == {(i, label) for i, w in texts.items() for label, words in sets if len(set(w) & set(words)) >= licenses.THRESHOLD * len(words) - 1e-9}


def test_packing_keeps_a_queue_for_each_of_many_sources(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(40)), "en", f"s{i % 400}", 0) for i in range(800)] + [(1000 + i, "hot words here " * 40, "en", "hot", 0) for i in range(400)]
    d = spark.createDataFrame(rows, DOC)
    got = packing.pack(d, window=2048, quantum=1).toPandas()
    total = got.groupby("source")["length"].sum()
    place = (got.sequence_id * 2048 + got.offset).to_numpy()
    order = np.argsort(place)
    assert (place[order] == np.concatenate([[0], np.cumsum(got.length.to_numpy()[order])[:-1]])).all()
    rounds = -(-int(total.sum()) // 2048)
    half = got[got.sequence_id < rounds // 2].groupby("source")["length"].sum().reindex(total.index).fillna(0)
    # half way each source, not its hash bucket, has had half of its tokens, but for about a round and a quantum
    assert (abs(half - total * (rounds // 2) / rounds) <= total / rounds + 2).all()
    shares = packing.pack(d, window=2048, weights={"hot": 1000.0}).toPandas()
    assert shares["length"].sum() == total.sum()


def test_packing_mixes_sources_within_its_bound_in_few_pieces(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 900))), "en", rng.choice(["a", "b", "b", "c", "c", "c", "c"]), 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOC)
    got = packing.pack(d).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) < 3 * 300
    total, before = got.groupby("source")["length"].sum(), collections.Counter()
    for source, length in zip(got.source, got.length, strict=True):
        before[source] += length
        for s in "abc":  # its share of what has been served so far, but for a quantum and a round
            assert abs(before[s] - total[s] * sum(before.values()) / total.sum()) <= packing.QUANTUM + 2048 + 2048 * total[s] / total.sum()
    finer = packing.pack(d, quantum=64).toPandas()
    assert len(finer) > len(got) and finer["length"].sum() == got["length"].sum()


def test_packing_of_very_many_sources(spark):
    d = spark.range(100_000).selectExpr("id AS doc_id", "concat('w', id % 10) AS text", "'en' AS lang", "concat('host', id) AS source", "2L AS n_chars")
    r = packing.pack(d).agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.max(F.expr("sequence_id * 2048 + offset + length")).alias("end"), F.countDistinct("source").alias("sources")).first()
    assert r.sources == 100_000 and r.tokens == r.end and r.n < 102_000


def test_quality_counts_and_verdict(spark):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choice(["the", "river", "runs", "slowly", "under", "old", "trees"]) + str(rng.randint(0, 9)) for _ in range(80))) for i in range(30)]
    bad = [(100 + i, " ".join(rng.choice(["$$", "%%", "##"]) + chr(rng.randint(65, 90)) * 3 + str(j) for j in range(80))) for i in range(10)]
    rows = {r.doc_id: r for r in quality.quality(docs(spark, good + bad + [(500, "a b c a b c\nz\nz")]), docs(spark, good)).collect()}
    assert all(rows[i].kept for i, _ in good) and not any(rows[i].kept for i, _ in bad)
    r = rows[500]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (8, 8, 0, 1, 6, True)


def test_toxicity_generalises_to_misspellings(spark):
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in ("ri", "sto", "ble", "than", "mo") for b in ("ver", "ne", "sh", "ing", "er")]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 2:
            for _ in range(3):
                words[rng.randint(0, 59)] = rng.choice(["grubbling", "grubbler", "skunkhead"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, i % 2))
    rows += [(1000, "river stone grubblingg moer " * 3), (1001, "river stone moer " * 3), (1002, None)]
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert held == [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == i % 2 for i in held]) >= 0.9
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].predicted == 0


def test_quality_equals_plain_loops(spark):
    """Counts, n-gram log ratios and verdicts of odd texts."""
    rng = random.Random(16)
    some = ["the", "river", "runs", "x#y", "$$", "é—ü", "w|", "a&b<c>", "zz", "11"]
    rows = [(i, "".join(rng.choice(some) + rng.choice([" ", " ", "\n", "\t ", "\n\n", "\u00a0"]) for _ in range(rng.randint(0, 160)))) for i in range(60)] + [(900, None), (901, ""), (902, "abc"), (903, "abcd")]
    trusted = [i for i in range(0, 60, 4)]
    got = {r.doc_id: r for r in quality.quality(docs(spark, rows), docs(spark, [(i, "") for i in trusted])).collect()}
    bucket = lambda g: int.from_bytes(g, "big") * 0x9E3779B1 % 2**32 >> 16
    grams = {i: [bucket(t[j : j + 4]) for j in range(len(t) - 3)] for i, t in ((i, (t or "").encode()) for i, t in rows)}
    raw, good = collections.Counter(), collections.Counter()
    for i, g in grams.items():
        raw.update(g)
        good.update(g if i in trusted else [])
    n_raw, n_good = sum(raw.values()) + 2**16, sum(good.values())
    prior = 0.001 * n_good + 1
    for i, t in rows:
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        shingles = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = {k for j in range(len(w) - 2) if shingles[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        base = lambda b: (raw[b] + 1) / n_raw
        score = sum(np.log((good[b] + prior * base(b)) / (n_good + prior) / base(b)) for b in grams[i]) / max(1, len(grams[i]))
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeat))
        assert abs(r.score - score) < 1e-5 and r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)
    parts = {r.doc_id: r.score for r in quality.quality(docs(spark, rows).repartition(7), docs(spark, [(i, "") for i in trusted])).collect()}
    assert parts == {i: r.score for i, r in got.items()}


def plain_worst(model, text, span):
    """Loops: mean bucket weight of each word, the largest mean of ``span`` words in a row."""
    values = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        for part in toxicity.stretches(w):
            bucket, _ = toxicity.subwords([part])
            values.append(sum(model.buckets[i] for i in bucket.tolist()) / len(bucket))
    if len(values) <= span:
        return sum(values) / len(values) if values else float("-inf")
    return max(sum(values[i : i + span]) / span for i in range(len(values) - span + 1))


@pytest.mark.parametrize("span", [1, 3])
def test_toxicity_scores_blocks_as_plain_loops_do(span):
    rng = random.Random(9)
    model = toxicity.Model(np.random.default_rng(9).normal(size=toxicity.BUCKETS), 0.0, 1.0, 0.0, span, most=300)
    some = ["...", "a", "aaaaaaa", "ü", "ÉTÉ", "x" * 90, "語" * 300 + "。" + "文" * 90, "a-" * 60] + ["".join(rng.choice("abAB.-é1_") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["", None, " \n "]
    got = np.concatenate([model.block(b) for b in words.blocks(pa.array(texts, pa.string()), block_bytes=2_000)])
    assert np.allclose(got, [plain_worst(model, t or "", span) for t in texts], rtol=0, atol=1e-9)
    grams, own = toxicity.subwords(["«Idiot!", "idiot", "Übel"])
    assert sorted(grams[own == 0]) == sorted(grams[own == 1]) and len(grams[own == 2]) == 1 + 4 + 3 + 2


def test_toxicity_never_reads_held_out_labels_or_texts_for_learning(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["river", "stone", "maple", "candle"]) + str(rng.randint(0, 40)) for _ in range(30)) + " grubbling" * (i % 2)) for i in range(150)]
    labels = [(i, 1, i % 2) for i in range(150)]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    other = [(i, "nothing of the kind" if out(i) else t) for i, t in rows]
    wrong = [(i, q, 1 - y if out(i) else y) for i, q, y in labels]
    kind = "doc_id long, quality int, toxic int"
    score = lambda r, y: {x.doc_id: x.score for x in toxicity.toxicity(docs(spark, r), spark.createDataFrame(y, kind)).collect() if not x.held_out}
    assert score(rows, labels) == score(other, wrong)


def test_toxicity_reads_runs_without_spaces_to_their_end(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("ri", "sto", "ble", "than", "mo") for b in ("ver", "ne", "sh", "ing", "er")]
    some = lambda n: [rng.choice(plain) for _ in range(n)]
    rows = [(i, " ".join(some(30) + ["grubbling"] * (i % 2) + some(30))) for i in range(240)]
    harmless = some(40)
    runs = ["-".join(harmless), "_".join(harmless), "\u200b".join(harmless), "http://x.org/" + "/".join(harmless), "".join(harmless)]
    rows += [(1000 + i, r) for i, r in enumerate(runs)] + [(2000 + i, r + j + "grubbling") for i, (r, j) in enumerate(zip(runs, ("-", "_", "\u200b", "/", ""), strict=True))]
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame([(i, 1, i % 2) for i in range(240)], "doc_id long, quality int, toxic int")).collect()}
    assert [got[1000 + i].predicted for i in range(4)] == [0] * 4 and [got[2000 + i].predicted for i in range(4)] == [1] * 4
    assert got[2004].score > got[1004].score
    for run in ("x" * 500, "語" * 300 + "。" + "文" * 90, "a-" * 200 + "b" * 70):
        assert set(run) - set("-。") <= set("".join(toxicity.stretches(run))) and max(map(len, toxicity.stretches(run))) <= toxicity.LONG
    assert "".join(p[: toxicity.STRETCH // 2] for p in toxicity.stretches("".join(map(chr, range(0x4E00, 0x4E64))))) == "".join(map(chr, range(0x4E00, 0x4E60)))


def test_html_keeps_the_article_alone():
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></li></ul></nav>
    <div class="cookie-notice">cookies</div><main><article><h1>Head &amp; more</h1><p><b>One.<br><p>Two&nbsp;  &lt;x&gt;<form><p>search</form><div class="ad">buy</div><section id="comments"><p>first!</p></section></article></main><aside>side</aside><footer>&copy;"""
    assert html_text.content(page) == "Head & more\nOne.\nTwo <x>"
    long = "A sentence, with some words; and an end. " * 5
    plain = f"<body><div><div><a href=1>home</a> <a href=2>news</a></div><div><p>{long}</p><p>{long}</p></div><div>short</div></div>"
    assert html_text.content(plain) == f"{long.strip()}\n{long.strip()}"
    assert html_text.content(None) == "" and html_text.content("<<<>") == html.unescape("<<<>")


def test_html_names_are_a_penalty_and_spare_the_article():
    long = "A sentence, with some words; and an end. " * 10
    inner = f"<header class='entry-header'><h1>Title</h1></header><p>{long}</p><div class='ad'>buy</div>"
    want = f"Title\n{long.strip()}"
    for opened in ("<article class='post has-sidebar'>", "<main class='no-sidebar'>", "<article class='post category-social tag-search'>", "<div id='page' class='nav-open'><article>", "<div class='widget'><main class='content sidebar'>"):
        assert html_text.content(f"<body><div class='cookie-notice'>cookies</div>{opened}{inner}") == want, opened
    for name in ("id='tags'", "class='related-work'", "class='has-comments'"):
        assert html_text.content(f"<article>{inner}<section {name}><h2>More</h2><p>{long}</p></section></article>") == f"{want}\nMore\n{long.strip()}", name
    remarks = "<section id='comments'>" + "<article class='comment'><p>Well, that is so.</p></article>" * 5 + "</section>"
    assert html_text.content(f"<body><article>{inner}</article>{remarks}</body>") == want
    assert html_text.content(f"<body><div class='post has-sidebar'>{inner.replace('header', 'div')}</div><div class='sidebar'><p>{long}</p></div></body>") == want


def test_html_path_scores_choose_a_subtree_with_its_short_blocks():
    long = "A sentence, with some words; and an end. " * 10
    body = f"<h1>A heading of thirty characters</h1><p>{long}</p><ul><li>short item</li><li>other</li></ul><h2>Next</h2><p>{long}</p>"
    want = f"A heading of thirty characters\n{long.strip()}\nshort item\nother\nNext\n{long.strip()}"
    around = "<body><div><ul><li><a href=1>home page</a></li><li><a href=2>news</a></li></ul></div>{}<div>short</div></body>"
    for inner in (f"<div>{body}</div>", f"<article>{body}</article>", f"<main><div>{body}</div></main>", body, body.replace("</h1>", "</h1><div>", 1) + "</div>"):
        got = html_text.content(around.format(inner if inner.startswith(("<div", "<a", "<m")) else f"<div>{inner}</div>"))
        assert got == want
    # scores decide although an article is declared
    assert html_text.content(around.format(f"<article><p>Teaser.</p></article><div>{body}</div>")) == want
    assert html_text.content("<article><a href=1>one</a> <a href=2>two</a></article>") == "one two"
    assert html_text.content(f"<body>{body}<div>short</div></body>") == want


def test_path_scores_equal_plain_loops():
    rng = random.Random(18)
    for n in (1, 2, 3, 12):
        keys = [(rng.randint(0, n), rng.random() < 0.5) for _ in range(n)]
        size = [rng.randint(1, 200) for _ in keys]
        link, stops, gain = [rng.choice([0, 0, s, s // 2]) for s in size], [rng.randint(0, 9) for _ in keys], [rng.choice([1.0, 4.0, 0.05]) for _ in keys]
        got, links = html_text.path_scores(keys, np.array(size, float), np.array(link, float), np.array(stops, float), np.array(gain))
        order = list(dict.fromkeys(keys))
        of = {k: [i for i, x in enumerate(keys) if x == k] for k in order}
        length = [sum(size[i] - link[i] for i in of[k]) / len(of[k]) for k in order]
        marks = [sum(stops[i] * (1 - link[i] / size[i]) for i in of[k]) / len(of[k]) for k in order]
        if len(order) > 2:
            near = lambda v: [0.1 * v[max(j - 1, 0)] + 0.8 * v[j] + 0.1 * v[min(j + 1, len(v) - 1)] for j in range(len(v))]
            length, marks = near(length), near(marks)
        for i, k in enumerate(keys):
            most = sum(link[j] for j in of[k]) > 0.5 * sum(size[j] for j in of[k])
            j = order.index(k)
            assert links[i] == most and abs(got[i] - (0 if most else (length[j] * (1 + marks[j])) ** 0.5 * gain[i])) < 1e-9


@pytest.mark.parametrize("piece", ["<a ", "<a '", "<div>x", "<p><b>x", "<!--", "<script></script", "<html ", "&", "<", "<p><span>a</p>"])
def test_html_of_bad_and_deep_pages_takes_linear_time(piece):
    began = time.process_time()
    html_text.content(piece * (500_000 // len(piece)))
    assert time.process_time() - began < 10


def test_html_keeps_text_of_inline_elements_and_cut_off_pages():
    assert html_text.content("<article><p>Press <button>Go</button> if <math><mi>x</mi></math> is so.") == "Press Go if x is so."
    assert html_text.content("<article><p>One.<p>Two <a href='x") == "One.\nTwo <a href='x"
    deep = "<div>" * 400 + "<p>In the deep.</p>" + "</div>" * 400 + "<p>After all, that is it.</p>"
    assert html_text.content(f"<main>{deep}</main><footer>no</footer>") == "In the deep.\nAfter all, that is it."


def test_html_on_the_given_pages_is_the_article_without_its_furniture():
    """With the article tags renamed, so that the path scores alone find it."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    bare = [re.sub(r"<(/?)(article|main)\b", r"<\1div", x) for x in pages]
    blocks = lambda x: html_text.parse(x)
    for page, other in zip(pages, bare, strict=True):
        tree = blocks(page)
        want = [t for t, e in zip(tree.text, tree.element, strict=True) if tree.root[e] and not tree.furniture[e] and all(p == 1 for p in _own_penalties(tree, e))]
        assert html_text.content(page) == html_text.content(other) == "\n".join(want)


def _own_penalties(tree, element):
    while element:
        yield tree.penalty[element]
        element = tree.parent[element]


def test_html_and_language_of_awkward_pages(spark):
    pages = [(1, "https://a.example.fr/fr/x", "<html lang='fr'><p>le chat et la rue de la ville est grande</p>"), (2, None, None), (3, "nonsense", "<p>the cat and the street of the town is large"), (3, "http://b.example.com/", "<html lang=en><p>the cat and the street of the town is large"), (None, "", "<html lang=en><p>123")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert html_text.extract_text(df).count() == 5 and html_text.extract_text(df.limit(0)).count() == 0
    got = [(r.page_id, r.language, r.accepted) for r in language_id.identify_pages(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "fr", True), (2, "und", False), (3, "en", True), (3, "en", True), (None, "und", False)], key=str)
    assert language_id.identify_pages(df.limit(0)).collect() == []


def plain_language(rows, bits=language_id.BUCKET_BITS):
    """Loops over texts, n-grams and languages: ``language, posterior`` of rows (text, declared, address, host, suffix)."""
    languages = sorted({r[1] for r in rows if r[1]})
    bucket = lambda g: int.from_bytes(g, "big") * 0x9E3779B1 % 2**32 >> 32 - bits
    grams = [[bucket(t[i : i + 3]) for i in range(len(t) - 2)] for t in ((r[0] or "").encode() for r in rows)]
    counts = {x: collections.Counter() for x in languages}
    for r, g in zip(rows, grams, strict=True):
        if r[1]:
            counts[r[1]].update(g)
    total = {x: sum(c.values()) + 0.1 * 2**bits for x, c in counts.items()}
    means = [{x: sum(np.log((counts[x][b] + 0.1) / total[x]) for b in g) / max(1, len(g)) for x in languages} for g in grams]
    looks = [max(languages, key=lambda x, m=m: m[x]) if any(c.isalpha() for c in r[0] or "") else None for m, r in zip(means, rows, strict=True)]
    n, out = len(languages), []
    for r, g, m, own in zip(rows, grams, means, looks, strict=True):
        if own is None:
            out.append(("und", 0.0))
            continue
        score = {}
        for x in languages:
            corpus = (sum(y == x for y in looks) + 1) / (sum(y is not None for y in looks) + n)
            prior = corpus
            for weight, same in ((language_id.SUFFIX_WEIGHT, lambda q: q[4] == r[4]), (language_id.HOST_WEIGHT, lambda q: q[3:] == r[3:])):
                near = [y for q, y in zip(rows, looks, strict=True) if y is not None and same(q)]
                prior = (near.count(x) - (own == x) + weight * prior) / (len(near) - 1 + weight)
            score[x] = m[x] * min(len(g), language_id.EFFECTIVE_GRAMS) + np.log(prior)
            for code, right in ((r[1], language_id.RIGHT_MARKUP), (r[2], language_id.RIGHT_ADDRESS)):
                score[x] += 0 if code is None else np.log(right if code == x else (1 - right) / max(1, n - 1))
        best = max(languages, key=lambda x: score[x])
        out.append((best, 1 / sum(np.exp(v - score[best]) for v in score.values())))
    return out


def test_language_id_equals_plain_loops_with_many_languages(spark):
    """Seventy languages, scored in many passes, in a few and all at once."""
    rng = random.Random(15)
    codes = [a + b for a in "abcdefghij" for b in "qrstuvw"]
    letters = {c: rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçøåß", 9) for c in codes}
    rows = []
    for i in range(280):
        c = codes[i % 70]
        text = " ".join("".join(rng.choice(letters[c]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 30)))
        rows.append((text, rng.choice([c, c, c, codes[0], None]), rng.choice([None, c]), f"h{i % 9}", f"s{i % 4}"))
    rows += [(None, "aq", None, "h1", "s1"), ("", None, None, "h1", "s1"), ("12 34", "aq", "aq", "h2", "s2"), ("x" * 9_000, None, None, "h3", "s3")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "uid long, text string, declared string, address string, host string, suffix string")
    want = plain_language(rows)
    for entries in (2_000, 9_000, language_id.MODEL_ENTRIES):
        got = {r.uid: (r.language, r.posterior) for r in language_id.identify(df, entries=entries).collect()}
        assert all(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-4 for i, w in enumerate(want))


def test_two_thousand_codes_take_one_pass(spark, monkeypatch):
    """Rare codes have few buckets; counts go on in parts when a task has met more languages than it holds."""
    assert language_id.passes([32_768] * 60 + [1_000] * 2_000, language_id.MODEL_ENTRIES) == [(0, 2060)]
    assert language_id.passes([5, 9, 1, 1, 1], 3) == [(0, 1), (1, 2), (2, 5)] and language_id.passes([0, 0], 0) == [(0, 2)]
    monkeypatch.setattr(language_id, "COUNTED_AT_ONCE", 3)
    codes = [a + b + c for a in "abcdefghijklmn" for b in "abcdefghijkl" for c in "qrstuvwxyzab"][:2_000]
    rows = [(i, f"{c} " * 9, c, None, f"h{i % 5}", None) for i, c in enumerate(codes)] + [(5_000, f"{codes[7]} " * 40, None, None, "h1", None)]
    df = spark.createDataFrame(rows, "uid long, text string, declared string, address string, host string, suffix string")
    counted = {(r.lang, r.bucket): r.n for r in language_id.gram_counts(df.coalesce(1), sorted(codes), 15).collect()}
    want = collections.Counter()
    for _, text, code, *_ in rows[:-1]:
        want.update((sorted(codes).index(code), int(b)) for b in quality.buckets(np.frombuffer(text.encode(), np.uint8), 15, 3))
    assert counted == want
    got = {r.uid: r.language for r in language_id.identify(df).collect()}
    assert got[5_000] == codes[7] and all(got[i] == c for i, c in enumerate(codes))


def test_language_is_declared_anywhere_outside_comments(spark):
    fr = "<p>le chat et la rue de la ville est grande</p>"
    pages = [(1, None, "<!--" + " <html lang=xx> " * 300 + f"--><html class='a' lang='fr-CA'>{fr}"), (2, None, " " * 5_000 + f"<HTML xml:lang=fr>{fr}"), (3, None, "<html lang=en><p>the cat and the street"), (4, None, "<html data-lang=de><p>the cat and the street")]
    declared = [(r.page_id, r.language) for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert declared == [(1, "fr"), (2, "fr"), (3, "en"), (4, "en")]


def test_scopes_remove_their_tables(spark):
    import pathlib

    from meetspark.llm import storage

    folder = pathlib.Path(storage.shared_dir(spark).removeprefix("file://")) / "meetspark"
    with storage.scope(spark):
        inside = storage.saved(spark.range(3), "some")
        kept = storage.saved(inside, "other", keep=True)
        assert len(list(folder.glob("scope-*/some-*"))) == 1
    assert not list(folder.glob("scope-*")) and kept.count() == 3


def test_pipeline_judges_rows_one_by_one(spark, tmp_path):
    """Repeated and missing ids, clashing columns and an empty table through all stages."""
    import corpus_pipeline

    rng = random.Random(19)
    say = lambda: " ".join(rng.choice(["red", "blue", "tall", "small", "house", "tree"]) + "abcdefgh"[rng.randint(0, 7)] * rng.randint(1, 3) for _ in range(40))
    item = " ".join(f"bench{i}" for i in range(12))
    rows = [(1, say()), (1, say() + " " + item), (None, say()), (None, say() + " " + item), (3, say()), (4, None), (4, "")]
    clean = {t for _, t in rows if t and "bench" not in t}
    for name, table in (("full", rows), ("none", [])):
        d = tmp_path / name
        clashing(docs(spark, table)).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        now = spark.read.parquet(str(d / "documents.parquet"))
        for stage, apply in corpus_pipeline.STAGES[:-1]:
            now = apply(spark, now, str(d))
            assert now.columns == corpus_pipeline.COLUMNS
        assert {r.text for r in now.collect()} == (clean if table else set())
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(d)).collect()} == ({1, None, 3} if table else set())


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["red", "blue", "tall", "small", "house", "tree", "walks", "sings"]) + str(rng.randint(0, 99)) for _ in range(60))
    item = " ".join(f"bench{i}" for i in range(12))
    rows = [(i, say()) for i in range(20)]
    rows += [(100, rows[3][1] + " extra words here at the end"), (101, say() + " " + item), (102, ""), (103, None), (104, "123 456")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS
        left.append({r.doc_id for r in now.select("doc_id").collect()})
    assert left[0] == set(range(20)) | {100, 101} and left[3] == left[2] - {101} and left[4] == left[3] and set(range(20)) <= left[3]
    assert now.select(F.sum("length")).first()[0] == sum(r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).select("length").collect())
