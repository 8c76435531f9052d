"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import html
import itertools
import math
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolake.llm import decontam, html_text, langid, licenses, lm_score, minhash, packing, quality, sharding, token_files, tokens
from geolake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, part int"
WORDS = [a + b for a in ("the", "an", "ou", "ri", "st", "é", "wh", "on") for b in ("er", "ing", "ly", "ed", "", "ation", "b", "q")]


def make(spark, texts, langs=None):
    """Documents with columns whose names operators use inside; ids from 0."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or ""), 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 12, 40, 80, 160, 400)]
    near = []
    for t in base[2:]:
        for k in range(6):
            w = t.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            near.append(" ".join(w))
    return [*base, *near, None, "", "   \n\t", "one", "ONE", "one two", base[3], base[3].upper(), prose(rng, 30_000), "日本語 テスト", "x\n\ny  z", *(prose(rng, rng.randint(1, 60)) for _ in range(40))]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- near duplicates ------------------------------------------------------------------------------------------------


def shingles(t, k):
    w = split(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, k):
    sets = [shingles(t, k) for t in texts]
    own = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(own[i], own[j])
            changed |= own[i] != m or own[j] != m
            own[i] = own[j] = m
    return sets, own


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, texts, k, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)  # small parts, so that groups are cut
    sets, own = brute_components(texts, k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(make(spark, texts), k).collect()}
    assert got == {i: (len(sets[i]), own[i], own[i] == i) for i in range(len(texts))}


def test_minhash_edges(spark, texts):
    assert minhash.link(empty(spark)).count() == 0
    d = make(spark, ["a b c d e f", "a b c d e f", None]).unionByName(spark.createDataFrame([(None, "a b c d e f", None, None, 1, 1, 1)], SCHEMA))
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.link(d).collect()), key=str)
    assert rows == [(0, 0, True), (1, 0, False), (2, 2, True), (None, None, True)]
    kept = minhash.keep(d.unionByName(d.where("doc_id = 0")), k=5)
    assert kept.columns == d.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [0, 2, None]
    # one id with different texts: both stay, unless they are copies of something
    other = make(spark, ["a b c d e f", "q r s t u v w x y z", "a b c d e f g", ""]).withColumn("doc_id", F.lit(0).cast("long"))
    kept = minhash.keep(d.unionByName(other).unionByName(other))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(0, ""), (0, "a b c d e f"), (0, "q r s t u v w x y z"), (2, None), (None, "a b c d e f")]
    assert minhash.keep(empty(spark)).count() == 0


def test_heavy_keys(spark, monkeypatch):
    """Rows of keys with many rows are joined where they are; the result is the same."""
    rng = random.Random(9)
    base = prose(rng, 80).split()
    many = [" ".join([*base[:j], f"x{i}", *base[j + 1 :]]) for i in range(60) for j in [rng.randrange(80)]] + ["same text again"] * 40 + [None] * 20 + [prose(rng, 50) for _ in range(20)]
    monkeypatch.setattr(minhash, "GROUP", 8)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 500)
    import geolake.llm.common as common

    monkeypatch.setattr(common, "HEAVY", 10)
    sets, own = brute_components(many, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(make(spark, many)).collect()} == {i: (len(sets[i]), own[i]) for i in range(len(many))}
    left = spark.createDataFrame([(i % 3 if i % 2 else i, i) for i in range(40)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.max("v").alias("m"))
    want = sorted(tuple(r) for r in left.join(right.drop("rows"), "k").collect())
    assert sorted(tuple(r) for r in common.spread_join(left, right, "k", "rows", 40).select("k", "v", "m").collect()) == want


def test_sketch_concentrates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
    a, b = np.unique(pool[:1500]), np.unique(pool[500:])
    same = np.mean(minhash.sketch(a) == minhash.sketch(b))
    assert abs(same - 0.5) < 0.2 and len(minhash.sketch(pool[:1])) == minhash.T and (minhash.sketch(a) == minhash.sketch(a)).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50) if i != 20] + [(99, 98), (98, 98), (99, 98)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {i: 0 if i <= 20 else 21 for i in range(51)} | {98: 98, 99: 98}
    assert components(links.limit(0)).count() == 0


# -- licenses ---------------------------------------------------------------------------------------------------------


def brute_licenses(texts):
    """Every start of every pattern in every text, tried one by one."""
    docs, known = [licenses.words_of(lower(t)) for t in texts], licenses.patterns()
    df = collections.Counter(x for w in docs for x in set(w))
    idf = {x: 1 + math.log((1 + len(docs)) / (1 + df[x])) for p in known for x in p.words}
    out = []
    for w in docs:
        found = []
        for p in known:
            own = sorted(set(p.words), key=lambda x: (df[x], x))
            own = own[: min(licenses.INDEXED, math.ceil(len(own) / 3))]
            for s in range(-len(p.words), len(w)):
                at = lambda i, s=s, w=w: w[s + i] if 0 <= s + i < len(w) else None
                agree = sum(at(i) == x for i, x in enumerate(p.words) if x in own)
                score = sum(idf[x] for i, x in enumerate(p.words) if at(i) == x) / sum(idf[x] for x in p.words)
                if agree >= math.ceil(len(own) / 2) and all(at(i) == x for i, x in p.must.items()) and (p.base or score >= licenses.LEAST_SCORE):
                    found.append((s, p.label, 1.0 if p.base else round(min(score, 1.0), 6), p.base))
        out.append(sorted(found))
    return out


def test_licenses(spark):
    mit, bsd = licenses.TEMPLATES[1][1], licenses.TEMPLATES[5][1]
    cut = mit.split()
    texts = [
        "Licensed under CC BY-NC 4.0. cc by cc by", "x (GNU) General\nPublic-License; all rights reserved", None, "", "İcc by", "All Rights reservedx", "Released under the MIT License." * 2, "rights reserved all", "mit license",
        "word " * 50, f"Copyright (c) me\n\n{mit}\n tail", " ".join([*cut[:40], "changed", *cut[41:]]), " ".join([*cut[:60], "put", "in", *cut[60:]]), " ".join(cut[20:]), bsd + " " + mit, "free of charge", mit.upper(), "license " * 300,
        "Licensed under the Apache License", "apache license " * 5, "permission is hereby granted free of charge and nothing else",
    ]
    got = {r.doc_id: r for r in licenses.scan(make(spark, texts)).collect()}
    for i, (t, want) in enumerate(zip(texts, brute_licenses(texts))):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(j, label) for p, label in licenses.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert [(m.start, m.label, m.score, m.base) for m in r.matches] == want, i
        assert r.labels == ",".join(sorted({m[1] for m in want})) and r.score == max([m[2] for m in want], default=0)
    assert "mit" in got[10].labels and got[11].labels == got[12].labels == "mit" and 0.9 < got[11].score < 1 and "cc-by-nc" in got[0].labels and "bsd-3-clause" in got[14].labels
    again = make(spark, texts[:2]).unionByName(make(spark, texts[:2])).withColumns({c: F.lit(1) for c in ("words", "hits", "held", "proposed")})
    assert licenses.scan(again).count() == 4 and licenses.scan(empty(spark)).count() == 0


# -- sharding ---------------------------------------------------------------------------------------------------------


def test_sharding(spark, texts):
    d = make(spark, texts)
    d = d.unionByName(d.limit(3)).unionByName(spark.createDataFrame([(None, "q", None, None, 1, 1, 1)], SCHEMA))
    rows = sharding.shard(d).collect()
    assert len(rows) == d.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        if r.doc_id is not None:
            t = (texts[r.doc_id] or "").encode()
            assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    again = {(r.doc_id, r.shard) for r in sharding.shard(d.where("doc_id % 2 = 0")).collect()}
    assert again <= {(r.doc_id, r.shard) for r in rows}  # other rows don't matter
    assert sharding.shard(empty(spark)).count() == 0


def test_slot_maps(spark):
    a, b = sharding.slot_owners(16), sharding.slot_owners(17)
    assert all(x == y or y == 16 for x, y in zip(a, b)) and max(collections.Counter(b).values()) - min(collections.Counter(b).values()) <= 1
    assert all(0 <= x - 4096 // n <= 1 for n in range(1, 20) for x in collections.Counter(sharding.slot_owners(n)).values())
    grown = sharding.grow(sharding.slot_map(spark, 16)).orderBy("vslot").collect()
    assert [r.shard for r in grown] == b and {r.version for r in grown} == {17}
    sizes = spark.createDataFrame([(v, 1, 100 if v < 256 else 1) for v in range(4096)], "vslot int, rows long, bytes long")
    m = sharding.rebalance(sharding.slot_map(spark, 16), sizes)
    held = [r["sum(bytes)"] for r in m.join(sizes, "vslot").groupBy("shard").sum("bytes").collect()]
    assert m.count() == 4096 and max(held) < 1.3 * sum(held) / 16 and m.first().version == 17


def test_rebalance_after_skewed_load(spark):
    """Bytes by slot of a table in which a few ids hold most of the text: the next map evens the shards, keeps slots of shards that have room."""
    docs = make(spark, ["x" * (20_000 if i % 97 == 0 else 10) for i in range(3000)])
    sizes = sharding.slot_sizes(docs).cache()
    rows = sharding.shard(docs).collect()
    by = collections.Counter()
    for r in rows:
        by[r.vslot] += r.size
    assert {r.vslot: r.bytes for r in sizes.collect()} == by and all(r.slot_bytes == by[r.vslot] and r.map_version == 16 for r in rows)
    # all of one shard's slots get heavier still
    heavy = sizes.withColumn("bytes", F.when(F.col("vslot") < 500, F.col("bytes") * 5).otherwise(F.col("bytes")))
    old = sharding.slot_map(spark, 16)
    load = lambda m: [r["b"] for r in m.join(heavy, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    new = sharding.rebalance(old, heavy)
    moved = new.join(old.withColumnRenamed("shard", "was"), "vslot").where("shard <> was")
    largest = heavy.agg(F.max("bytes")).first()[0]
    assert max(load(new)) < max(load(old)) and max(load(new)) <= 1.05 * sum(load(new)) / 16 + 2 * largest and 0 < moved.count() < 2000 and new.select("vslot").distinct().count() == 4096


# -- tokens -------------------------------------------------------------------------------------------------------------

ODD = ["", "a", "don't", "it's.' x", "é a≮b", "İstanbul ΑΣ Σ.", "  two  spaces\n\n new\t tab", "a b", "<|endoftext|> hi", "x—y. “q”…", "日本語 テスト", "naïve Straße ẞ", "'s 'll I'LL", "1,234.5 m²", "\n lead", "trail \n", "a \nb", " \n ", "é", "×÷ é×e", None]


@pytest.mark.parametrize("name", sorted(tokens.KEEPS_SPACE))
def test_pieces_join_to_whole_texts(name, texts):
    rng = random.Random(3)
    many = ODD + ["".join(rng.choices("aZé' \n.,!_-1—“Σİ日<|>\t×́", k=rng.randint(1, 30))) for _ in range(1500)] + ["".join(rng.choices("ab.' \n", k=rng.randint(1, 20))) for _ in range(1500)] + texts
    enc = tokens.encoder(name)
    want = [[*x, 2] for x in enc.whole([t or "" for t in many])]
    got = [ids[a:b].tolist() for _, _, ids, at in enc.encode(pa.array(many), 2) for a, b in zip(at[:-1], at[1:])]
    assert got == want


def test_token_files(spark, texts, tmp_path):
    many = texts + ODD
    path = str(tmp_path / "t")
    token_files.write_tokens(make(spark, many), path)
    got = {r.doc_id: r for r in token_files.token_index(spark, path).collect()}
    ids = tokens.encoder("word_bpe_49k.json").whole([t or "" for t in many])
    start = 0
    for i, x in enumerate(ids):
        x = [*x, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    part = token_files.read_tokens(spark, path, 3, 5)
    assert sorted((r.doc_id, list(r.ids)) for r in part.collect()) == [(i, [*ids[i], 2]) for i in (3, 4, 5)]
    plan = part.select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan.split("PushedFilters")[1] and "ids" not in plan.split("ReadSchema")[1]
    token_files.write_tokens(empty(spark), str(tmp_path / "e"))
    assert token_files.token_index(spark, str(tmp_path / "e")).count() == 0


def test_packing(spark, texts):
    many = texts + ODD + texts[:3]
    rows = packing.pack(make(spark, many)).collect()
    by = collections.defaultdict(list)
    place = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        place[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(tokens.encoder("byte_bpe_50k.json").whole([t or "" for t in many])):
        x, at = [*x, 2], 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and (r.length == 1024 or k == 0) and r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)
    for own in place.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty(spark)).count() == 0
    # repeated rows, also under one id, and lengths that are numbered in several groups
    packing_rows = packing.GROUP_ROWS
    packing.GROUP_ROWS = 3
    try:
        again = make(spark, ["same text"] * 20 + ["other"] * 3).withColumn("doc_id", F.col("doc_id") % 2)
        rows = packing.pack(again).collect()
    finally:
        packing.GROUP_ROWS = packing_rows
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len(rows) == 23 and len({r.sequence_id for r in rows}) == 1 and all(a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:])) and spans[0][1] == 0


def test_plan_is_tight():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.choice([rng.randint(1, 1024), rng.randint(1, 340), 1024, rng.randint(300, 700)]) for _ in range(rng.choice([1, 5, 60, 900]))]
        runs = packing.plan(dict(collections.Counter(lengths)))
        used, place = collections.Counter(), collections.defaultdict(list)
        for n, _, count, first, offset in runs:
            used[n] += count
            for j in range(count):
                place[first + j].append((offset, n))
        assert used == collections.Counter(lengths) and all(sum(n for _, n in x) <= 1024 for x in place.values())
        gaps = sorted(lengths, reverse=True)  # first-fit decreasing for comparison
        rooms: list[int] = []
        for n in gaps:
            k = next((k for k, r in enumerate(rooms) if r >= n), None)
            if k is None:
                rooms.append(1024 - n)
            else:
                rooms[k] -= n
        assert len(place) <= 1.01 * len(rooms) + 1


# -- language, quality, decontamination ---------------------------------------------------------------------------------


def brute_ppm(train):
    """Code length in bits of a text under a language, by escape method C over contexts of up to three bytes of (lang, text) pairs."""
    trees = {}
    for lang, t in train:
        x = b"\n\n\n" + t.encode()
        own = trees.setdefault(lang, [collections.defaultdict(collections.Counter) for _ in range(4)])
        for i, k in itertools.product(range(3, len(x)), range(4)):
            own[k][x[i - k : i]][x[i]] += 1

    def bits(lang, t):
        x, total = b"\n\n\n" + t.encode(), 0.0
        for i in range(3, len(x)):
            for k in (3, 2, 1, 0, None):
                if k is None:
                    total += math.log2(257)
                    break
                c = trees[lang][k].get(x[i - k : i])
                if not c:
                    continue
                n, q = sum(c.values()), len(c)
                if c[x[i]]:
                    total += math.log2((n + q) / c[x[i]])
                    break
                total += math.log2((n + q) / q)
        return total

    return bits, sorted(trees)


def test_code_lengths_are_exact():
    train = [("en", "the thing is there\nand the other"), ("fr", "le théâtre est là"), ("fr", "une chose"), ("en", "")]
    b = pa.RecordBatch.from_pydict({"lang": [a for a, _ in train], "text": [t for _, t in train]})
    counts = {}
    for out in langid.count_contexts([b]):
        p = out.to_pandas()
        counts = {k: (g.gram.to_numpy(), g.n.to_numpy()) for k, g in p.groupby("lang")}
    m = langid.Model(counts)
    bits, _ = brute_ppm(train)
    tests = ["the", "", "là une thing", "日本", "x" * 50]
    from geolake.llm.common import text_buffer

    got = m.code_lengths(*text_buffer(pa.array(tests)))
    assert np.allclose(got, [[bits(k, t) for k in m.langs] for t in tests], atol=1e-2)


def test_predictions_against_brute_force(spark):
    """Every row's language and score, from a table with nulls, ties of languages, repeated rows and texts that weren't learned from."""
    rng = random.Random(13)
    parts = {"en": ("the", "ing", "tion", "er"), "fr": ("le", "é", "tion", "oi"), "zz": ("the", "ing", "tion", "er")}
    rows = [(i, "".join(rng.choice(parts[k]) + rng.choice(("", " ")) for _ in range(rng.randint(1, 30))), k) for i, k in enumerate(rng.choices(["en", "fr", "zz"], k=60))]
    rows += [(60, None, "en"), (61, "", None), (62, "123 .", "fr"), (63, "théâtre", None), (0, rows[0][1], rows[0][2])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    bits, langs = brute_ppm([(k, t) for i, t, k in rows if t is not None and k and learned(i)])
    got = collections.Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.identify(d, langid.train(d, fold)).collect())
    want = collections.Counter()
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            want[i, "und", 0.0] += 1
            continue
        cost = [bits(k, t) for k in langs]
        want[i, langs[int(np.argmin(cost))], round(1 / sum(2.0 ** (min(cost) - c) for c in cost), 3)] += 1
    close = lambda c: sorted((i, k, n) for (i, k, _), n in c.items())
    assert close(got) == close(want) and all(abs(a[2] - b[2]) < 0.01 for a, b in zip(sorted(got), sorted(want)))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(10_001, None, "en", None, 0), (10_002, "12 ...", "en", None, 0), (10_003, "", None, None, 0)], docs.schema)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    got = langid.identify(docs.unionByName(more), langid.train(docs.unionByName(more), fold != 2)).join(docs.unionByName(more).select("doc_id", "lang", (fold == 2).alias("held")), "doc_id").collect()
    held = [r for r in got if r.held and r.doc_id < 10_000]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id > 10_000} == {"und"}
    assert langid.identify(docs, langid.train(docs.limit(0))).first().lang_pred == "und" and langid.identify(docs.limit(0), langid.train(docs)).count() == 0
    assert langid.keep(docs).columns == docs.columns


def test_quality_measures(texts):
    many = texts + ["a b c d e a b c d e f", "x\nx\ny\n\n \nx", "### a|b <c> $%&*", "b a c"]
    got = dict(zip(quality._NAMES, quality.measure(pa.array(many))))
    for i, t in enumerate(many):
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[n][i]) for n in quality._NAMES[:5]) == want


def test_quality_risk(spark):
    assert abs(quality.binomial_tail(2, 10, 0.3) - sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3))) < 1e-12
    good, bad = np.zeros(200, int), np.zeros(200, int)
    good[:5], bad[100:110] = 400, 50
    cut = quality.certify(good, bad, 0.01, 0.01)
    assert 5 <= cut <= 100 and quality.certify(good[:0], bad[:0], 0.01, 0.01) is None and quality.certify(good // 100, bad, 0.01, 0.01) is None
    rng = random.Random(1)
    clean, junk = [prose(rng, 60) for _ in range(1500)], [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(300)]
    docs = make(spark, [*clean, *junk, None, "few words"])
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1800)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels, alpha=0.05).collect()}
    assert sum(not got[i].kept for i in range(1500)) <= 0.05 * 1500 and sum(got[i].kept for i in range(1500, 1800)) == 0
    assert got[1800].base_failed and got[1801].base_failed and not got[1800].kept
    kept = quality.keep(docs, labels, alpha=0.05)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert all(r.kept == (not r.base_failed) for r in quality.judge(docs, labels.limit(0)).collect()) and quality.judge(empty(spark), labels).count() == 0


def test_quality_rules_complement(spark):
    """The second-best rule sees what the best one sees; a kind of poor text that only the third-best one sees is caught as well."""
    rng = random.Random(2)
    clean, junk = [prose(rng, 60) for _ in range(1500)], [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(300)]
    same = [" ".join(w for w in rng.sample(WORDS, 20) for _ in range(3)) for _ in range(120)]
    docs = make(spark, [*clean, *junk, *same])
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1920)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels, alpha=0.05).collect()}
    assert not any(got[i].base_failed for i in range(1920)) and sum(not got[i].kept for i in range(1500)) <= 0.05 * 1500
    assert sum(got[i].kept for i in range(1500, 1800)) == 0 and sum(got[i].kept for i in range(1800, 1920)) <= 2


def brute_leaks(docs, items, k=5):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    sets = {}
    for i, t in enumerate(items):
        w = tok(t)
        if w:
            n = min(k, len(w))
            sets[i] = (len(w), n, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
    df = collections.Counter(x for _, _, s in sets.values() for x in s)
    weight = lambda x: math.log((len(sets) + 1) / (df[x] + 0.5))
    out = {}
    for d, t in enumerate(docs):
        w = tok(t)
        for i, (size, n, s) in sets.items():
            span = min(size, len(w))
            best = max((sum(map(weight, s & {tuple(w[j : j + n]) for j in range(a, a + span - n + 1)})) for a in range(len(w) - span + 1)), default=0) if span >= n else 0
            if best >= 0.8 * sum(map(weight, s)) - 1e-9:
                out[d, i] = round(best / sum(map(weight, s)), 6)
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (30, 45, 60, 5, 3, 1)] + [None, ""]
    docs = [prose(rng, 200) for _ in range(12)] + [None, "", prose(rng, 3)]
    for d, i in ((0, 0), (1, 1), (2, 2), (2, 0), (3, 3)):
        docs[d] += " " + re.sub("[a-z]", lambda m: m[0].upper(), items[i]).replace(" ", ", ") + ". " + prose(rng, 50)
    w = items[1].split()
    docs[5] += " " + " ".join([*w[:20], "zzz", *w[21:]]) + " tail"  # one word changed
    docs[6] += " " + " ".join([*w[:20], "zzz", "yyy", *w[20:]])  # two put in
    docs[7] = items[2][: len(items[2]) * 9 // 10]  # shorter than the item
    docs[8] += " " + " ".join(w[:12])  # a small part only
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontam.leaks(make(spark, docs), bench).collect()}
    want = brute_leaks(docs, items)
    assert got == want and {(0, 0), (1, 1), (2, 2), (2, 0), (5, 1)} <= set(got)
    kept = decontam.keep(make(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in got}
    assert decontam.leaks(make(spark, docs), bench.limit(0)).count() == 0 and decontam.leaks(empty(spark), bench).count() == 0


def test_near_copies_of_repeated_items(spark):
    """Shingles that many items share weigh little, so a changed word's shingles outweigh them in a window; the copies count all the same."""
    rng = random.Random(3)
    common, other = prose(rng, 30).split(), prose(rng, 40).split()
    items = [" ".join(common) for _ in range(20)] + [" ".join(other)] + [prose(rng, 30) for _ in range(39)]
    docs = []
    for w in [common] * 20 + [other] * 5:
        j = rng.choice([*range(5), *range(len(w) - 5, len(w))]) if rng.random() < 0.5 else rng.randrange(len(w))
        docs.append(" ".join([prose(rng, 40), *w[:j], f"new{len(docs)}", *w[j + 1 :], prose(rng, 40)]))
    docs.append(" ".join([*common[:26], *["again"] * 4, *common]))  # repeats of a shingle count once
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.leaks(make(spark, docs), bench).collect()
    got, want = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in rows}, brute_leaks(docs, items)
    assert got == want and len({d for d, _ in want}) > 20
    assert {r.first_word for r in rows if r.doc_id == 25} == {30}
    assert {r.doc_id for r in decontam.keep(make(spark, docs), bench).collect()} == set(range(len(docs))) - {d for d, _ in want}


def edited(rng, w, other):
    """w with words changed, put in or taken out, its halves swapped, or cut and followed by another item."""
    kind, j = rng.randrange(6), rng.randrange(len(w))
    if kind == 0:
        return [*w[:j], f"new{rng.random()}", *w[j + 1 :]]
    if kind == 1:
        return [*w[:j], "put", "in", *w[j:]]
    if kind == 2:
        return w[:j] + w[j + 1 :]
    if kind == 3:
        return w[len(w) // 2 :] + w[: len(w) // 2]
    cut = int(len(w) * rng.uniform(0.05, 0.22))
    return [*w[cut:], *other] if kind == 4 else [*other, *w[: len(w) - cut]]


def test_multi_index_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    items = [prose(rng, rng.randint(14, 40)) for _ in range(40)]
    docs = [" ".join([prose(rng, rng.randint(1, 20)), *edited(rng, rng.choice(items).split(), rng.choice(items).split()), prose(rng, rng.randint(1, 20))]) for _ in range(150)]
    want = brute_leaks(docs, items)
    limit = [s for s in want.values() if s < 0.85]
    assert len(want) > 70 and len(limit) > 8
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = make(spark, docs + [None, "", "nothing " * 40, "of the kind"])
    rows = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontam.leaks(d, bench).collect()}
    assert rows == want
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 15)  # several blocks: the same weights and rows
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontam.leaks(d, bench).collect()} == want
    kept = decontam.keep(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs) + 4)) - {i for i, _ in want})


def test_multi_index_guarantees_its_radius():
    """Every fingerprint within the radius is found, no other; random ones are not even near."""
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, (500, decontam.BITS // 64)).astype(np.uint64)
    m = decontam.Multi(prints)
    for i in range(60):
        bits = np.unpackbits(prints[i].view(np.uint8))
        bits[rng.choice(decontam.BITS, rng.integers(decontam.RADIUS - 20, decontam.RADIUS + 20), replace=False)] ^= 1
        p = np.packbits(bits).view(np.uint64)
        want = np.flatnonzero(np.bitwise_count(prints ^ p).sum(1) <= decontam.RADIUS)
        assert m.within(p.tobytes()).tolist() == want.tolist()
    assert sum(len(m.within(x.tobytes())) for x in rng.integers(0, 2**63, (200, decontam.BITS // 64)).astype(np.uint64)) == 0


def test_leaks_of_repeated_rows(spark):
    """Repeated documents and items give a row for each pair, also under one id; clashing names and null ids are carried."""
    item = prose(random.Random(6), 20).replace("é", "e")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item.upper()), (None, item), (3, None)], "item_id long, text string")
    docs = make(spark, [f"before {item} after"]).unionByName(make(spark, [f"before {item} after"])).withColumns({c: F.lit(1) for c in ("item_id", "similarity", "n", "shingles", "print")})
    got = sorted((r.doc_id, -1 if r.item_id is None else r.item_id, r.first_word) for r in decontam.leaks(docs, bench).collect())
    assert got == [(0, -1, 1), (0, -1, 1), *[(0, 1, 1)] * 4, (0, 2, 1), (0, 2, 1)]
    assert decontam.keep(docs, bench).count() == 0 and decontam.keep(docs.limit(0), bench).columns == docs.columns


# -- html, language model --------------------------------------------------------------------------------------------------


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def reference(h):
        a = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", h or "")
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", a[1]) if a else []
        flat = (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", b.replace("<br>", " "))).split()) for b in blocks)
        return "\n\n".join(x for x in flat if x)

    more = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9003, "u", "<nav>a</nav>")], pages.schema)
    rows = html_text.extract_pages(pages.unionByName(more).withColumn("text", F.lit(1))).collect()
    want = {r.page_id: reference(r.html) for r in pages.collect()} | {9001: "", 9002: "", 9003: ""}
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


PAGE = """<html><head><title>x</title></head><body><header class="site-header"><h1>Site name</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies to improve
your experience on this site, as others do.</div><div id="wrap"><div class="sidebar"><p>Popular posts this week, a list of good things.</p></div><div class="content"><h1>The title</h1><p>First paragraph &amp; more text, it goes
on for quite a while, really.<div class="ad">Buy this thing now</div><p>Second   paragraph<br>line &eacute; goes on and on. Another sentence here.</p></div><div class="comments"><p>Nice article, I liked it very much,
thanks a lot.</p></div></div><form><button>Send</button></form><footer>&copy; me</footer></body></html>"""


def sample_pages():
    import duckdb

    return duckdb.sql("select url, html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()


def test_html_names_and_shapes():
    pages = sample_pages()
    # what names mean is learned from pages that show it: these have such elements outside of their articles
    rng, named = random.Random(3), []
    for i in range(120):
        said = [prose(rng, rng.randint(6, 25)).capitalize() + "." for _ in range(9)]
        named.append((f"http://h{i % 20}/p{i}", f"<body><div class='cookie-notice'>{said[0]}</div><div class='sidebar'><p>{said[1]}</p></div><article><div class=content><h1>{said[8]}</h1>" + "".join(f"<p>{x} {x}</p>" for x in said[2:6])
                      + f"</div></article><div class='comments'><p>{said[6]}</p><p>{said[7]}</p></div><footer>x</footer></body>"))
    model = html_text.Extractor(pages + named)
    assert model.extract([PAGE]) == ["The title\n\nFirst paragraph & more text, it goes on for quite a while, really.\n\nSecond paragraph line é goes on and on. Another sentence here."]
    t = html_text.Tree('<div><p>a<p>b<script>"</p>"</script>c<!-- <p> --><ul><li>d<li>e</ul><p cl')
    assert [s for _, s in t.runs] == ["a", "bc", "d", "e"]
    precision, recall = html_text.quality(pages)
    assert precision > 0.98 and recall > 0.98
    # nothing but the evidence of hosts to learn from
    precision, recall = html_text.quality(pages, telling=False)
    assert precision > 0.95 and recall > 0.95


def test_html_articles_under_any_name():
    """No name vetoes an article; comments inside of one go, its lists and tables stay."""
    model = html_text.Extractor(sample_pages())
    long = "Some words of a long paragraph, which has several sentences. It goes on and on, as paragraphs do. " * 3
    art = "<h1>Title of the page</h1>" + "".join(f"<p>{long} {i}.</p>" for i in range(6))
    said = "".join(f"<div class='item'><div>Anna, {i + 1} hours ago</div><p>I do not agree with this at all. Nice text {i}.</p></div>" for i in range(4))
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav>{}<footer>&copy; me 2020</footer></body></html>"
    whole = "\n\n".join(["Title of the page", *(f"{long.strip()} {i}." for i in range(6))])
    listed = "<ul><li>First thing</li><li>Second thing, 2020-01-05</li><li>Third one</li></ul>"
    rows = "<table><tr><td>2020-01-05</td><td>Value one</td></tr><tr><td>2020-01-06</td><td>Value two</td></tr></table>"
    for body, want in (
        (f"<article><div class='more-text'>{art}</div></article>", whole), (f"<article><div id='legal-notices'>{art}</div></article>", whole), (f"<div class='more-text'>{art}</div>", whole),
        (f"<article>{art}<p class='alert'>{long}</p></article>", f"{whole}\n\n{long.strip()}"), (f"<article>{art}<div class='responses-list'>{said}</div></article>", whole), (f"<article>{art}<div class='comments'>{said}</div></article>", whole),
        (f"<article>{art}</article><div class='x'>{said}</div>", whole), (f"<article>{art}{listed}</article>", f"{whole}\n\nFirst thing\n\nSecond thing, 2020-01-05\n\nThird one"),
        (f"<article>{art}{rows}</article>", whole + "".join(f"\n\n{x}" for x in ("2020-01-05", "Value one", "2020-01-06", "Value two"))),
    ):
        assert model.extract([page.format(body)]) == [want], body[-200:]


def test_series_of_comments():
    def series(page):
        t = html_text.Tree(page)
        return [s for node, s in t.runs if html_text.series(t)[node]]

    item = "<li><b>Anna</b> 3.4.2020<p>{}</p></li>"
    assert series("<ul>" + item.format("one") + item.format("two") + "</ul><p>rest") == ["Anna 3.4.2020", "one", "Anna 3.4.2020", "two"]
    assert series("<ul><li>3.4.2020 a</li><li>3.4.2020 b</li></ul>") == []  # a list of dated lines
    assert series("<table><tr><td>3.4.2020</td><td>a</td></tr><tr><td>3.4.2020</td><td>b</td></tr></table>") == [] == series("<ul>" + item.format("one") + "</ul>")
    assert series("<div><p>3 hours ago</p><p>" + "long " * 400 + "</p></div>" * 2) == []


def plain_boosting(x, y, want):
    """Boosted trees by the book: every cut of every feature of every node is tried over the rows themselves."""
    cuts = [k / (html_text.BINS // 2) for k in range(1, html_text.BINS // 2)]
    edges = [sorted({float(np.quantile(c, q)) for q in cuts} | {float(np.quantile(sorted(set(c.tolist())), q, method="lower")) for q in cuts}) for c in x.T]
    binned = [[sum(e < v for e in es) for es, v in zip(edges, row)] for row in x.tolist()]
    asked = [[sum(e < v for e in es) for es, v in zip(edges, row)] for row in want.tolist()]
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    f, out = [base] * len(y), [base] * len(want)
    for _ in range(html_text.TREES):
        p = [1 / (1 + math.exp(-v)) for v in f]
        g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

        def grow(own, others, depth):
            if depth == html_text.DEPTH:
                value = html_text.RATE * sum(g[i] for i in own) / (sum(h[i] for i in own) + 1)
                for i in own:
                    f[i] += value
                for i in others:
                    out[i] += value
                return
            best, at = 1e-6, None
            score = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)
            for j in range(x.shape[1]) if len(own) >= 2 * html_text.LEAST_LEAF else ():
                for cut in range(html_text.BINS):
                    a, b = [i for i in own if binned[i][j] <= cut], [i for i in own if binned[i][j] > cut]
                    if min(len(a), len(b)) >= html_text.LEAST_LEAF and score(a) + score(b) - score(own) > best + 1e-12:
                        best, at = score(a) + score(b) - score(own), (j, cut)
            left = lambda rows, of: [i for i in rows if at is None or of[i][at[0]] <= at[1]]
            a, b = left(own, binned), left(others, asked)
            grow(a, b, depth + 1)
            grow([i for i in own if i not in set(a)], [i for i in others if i not in set(b)], depth + 1)

        grow(list(range(len(y))), list(range(len(want))), 0)
    return out


def test_trees_against_plain_ones(monkeypatch):
    monkeypatch.setattr(html_text, "TREES", 5)
    monkeypatch.setattr(html_text, "BINS", 6)
    monkeypatch.setattr(html_text, "LEAST_LEAF", 4)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    want = np.round(rng.normal(size=(40, 3)), 1)
    assert np.allclose(html_text.Boosted(x, y).log_odds(want), plain_boosting(x, y, want), atol=1e-9)


def test_files_and_pages_of_odd_tables(spark):
    """Token files and pages with null, repeated and missing ids, clashing columns and a very long text."""
    rng = random.Random(6)
    rows = [(5, "one two"), (5, "one two"), (3, None), (None, "no id"), (-2, ""), (9, prose(rng, 40_000)), (5, "other text")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, start long, ids int, n_tokens int")
    path = f"{docs.sparkSession.conf.get('spark.checkpoint.dir')}/odd-tokens"
    token_files.write_tokens(docs, path)
    found = token_files.token_index(spark, path).orderBy("start").collect()
    enc = tokens.encoder(token_files.VOCABULARY)
    count = {t: sum(len(ids) for *_, ids, _ in enc.encode(pa.array([t], pa.string()), token_files.END)) for _, t in rows}
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [(r.doc_id, r.n_tokens) for r in found] == [(i, count[t]) for i, t in ordered]
    assert [r.start for r in found] == [0, *itertools.accumulate(count[t] for _, t in ordered)][:-1]
    assert count[None] == count[""] == 1
    empty_path = path + "-empty"
    token_files.write_tokens(docs.limit(0), empty_path)
    assert token_files.token_index(spark, empty_path).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>x", 1, "t"), (1, "u", "<p>x", 1, "t"), (None, None, "<article><p>A long text, it is. " + "word " * 60_000, 2, "t")], "page_id long, url string, html string, n_chars int, text string")
    more = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id + 10 page_id", "url", "html", "1 n_chars", "'t' text")  # to learn from
    texts_of = [r for r in html_text.extract_pages(pages.unionByName(more)).collect() if (r.page_id or 0) < 10]
    assert len(texts_of) == 3 and len({r.text for r in texts_of if r.page_id == 1}) == 1 and max(r.n_chars for r in texts_of) > 290_000


def test_decoding_against_enumeration():
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(1, 8)
        t = html_text.Tree("")
        for _ in range(n):
            t.tag.append("div")
            t.parent.append(rng.randrange(len(t.parent)))
        odds = np.array([rng.choice([rng.gauss(0, 3), 0.0]) for _ in range(n + 1)])
        worth = lambda kept: sum(-math.log1p(math.exp(-o if k else o)) for k, o in list(zip(kept, odds))[1:])
        whole = [(True, *x) for x in itertools.product([False, True], repeat=n)]
        best = max(worth(k) for k in whole if all(k[t.parent[i]] for i in range(1, n + 1) if k[i]))
        got = html_text.decode(t, odds)
        assert all(got[t.parent[i]] for i in range(1, n + 1) if got[i]) and math.isclose(worth(got), best, abs_tol=1e-9)


def test_labels_by_evidence():
    words = lambda t, y: {s: int(y[node]) for node, s in t.runs}
    t = html_text.Tree("<div class=comments>out</div><main><header>head</header><div class=ad>in</div><aside>side</aside></main>")
    assert words(t, html_text.labels(t, set())) == {"out": 0, "head": 1, "in": 1, "side": 0}
    long = "This paragraph is of some length, as one would expect of an article. It has sentences, too."
    t = html_text.Tree(f"<nav>menu</nav><div>plain</div><p>{long}</p><p>{long} Again.</p>")
    assert words(t, html_text.labels(t, {"plain", long + " Again."})) == {"menu": 0, "plain": 0, long: 1, long + " Again.": 0}


def test_hostile_pages_are_read_once():
    import time

    n = 1_000_000
    fill = lambda x: (x * (n // len(x) + 1))[:n]
    pages = [fill(x) for x in ("<a ", '"', '<a x="', "<a x='y\" ", '<a "', "<!--", "<script>", "<", "&amp;", "<div class='a", "</script ")]
    pages += ["<div>" * 50_000 + fill("</p></b></section>"), "<ul><li>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<script>" + fill("</script "), "<a " + fill("= '\"") + ">", "<div " + fill("class='") + ">"]
    for page in pages:
        began = time.process_time()
        html_text.Tree(page)
        assert time.process_time() - began < 3, page[:20]
    for page, want in (
        ('<p>a<b x="1>2">c</b></p>', ["ac"]), ("<p>x<a href='>y'>z", ["xz"]), ("<p don't>ok</p>", ["ok"]), ("<p>a < b > c</p>", ["a < b > c"]), ('<p>cut <a href="x', ["cut"]), ('<p>q <a title="it\'s">r</a>', ["q r"]),
        ("<p><math><mi>x</mi></math> <noscript>n</noscript> <object>o</object></p>", ["x n o"]), ("<svg><text>t</text></svg><p>u", ["u"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
    ):
        assert [s for _, s in html_text.Tree(page).runs] == want


def test_lm_scores(spark, texts):
    many = texts + ["the " * 100, "unseen0 words1 only2"]
    docs = make(spark, many)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0
    got = {r.doc_id: r for r in lm_score.score(docs, train, frequent=20).collect()}
    w = [[*split(lower(t)), None] for t in many]
    c = collections.Counter(x for i, ws in enumerate(w) if not held(i) for x in ws)
    total, v = sum(c.values()), len(c)
    for i, ws in enumerate(w):
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[x] > 0 for x in ws), total) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm_score.score(empty(spark), F.lit(True)).count() == 0
    none = lm_score.score(make(spark, ["a b", None]), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


@pytest.mark.parametrize("most", [0, 40, 400])
def test_pairs_beyond_the_table(spark, texts, most):
    """Pairs that the table of fixed size doesn't hold are joined: scores are those of a model that holds all pairs."""
    docs = make(spark, texts + ["the " * 100, "unseen0 words1 only2"])
    train = F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True))
    got = {r.doc_id: r.score for r in lm_score.score(docs, train, most_pairs=most).collect()}
    pairs = lm_score.counts_of(docs.where(train)).where(F.col("kind") == lm_score.TWO_IDS).select("key", "n")
    model = lm_score.fit_attention(docs.where(train), pairs, most_pairs=most)
    whole = sorted((r.key, r.n) for r in pairs.collect())
    assert not model.whole and len(model.pairs) <= most < len(whole)
    # the same model with all pairs at hand; its counts of classes are over all pairs already
    behind = np.zeros_like(model.behind)
    np.add.at(behind, (model.row[[k // lm_score.SIZE for k, _ in whole]], model.cls[[k % lm_score.SIZE for k, _ in whole]]), [n for _, n in whole])
    assert (behind == model.behind).all()
    model.pairs, model.n_pair, model.whole = np.array([k for k, _ in whole]), np.array([n for _, n in whole], np.float32), True
    for r in docs.collect():
        (lo, hi, ids, at), *_ = lm_score.encoder(lm_score.VOCABULARY, None).encode(pa.array([r.text or ""]), lm_score.END)
        assert math.isclose(got[r.doc_id], model.score(ids, at)[0], rel_tol=1e-5, abs_tol=1e-5)


def test_attention_is_causal_and_complete():
    from geolake.llm import attention as at

    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, n) for n in (5, 40, 200, 33)]
    size, begin = 300, 299
    texts = [np.concatenate([t, rng.integers(0, 290, 30)]) for t in texts]
    both = np.concatenate([np.concatenate([[begin], t[:-1]]) * size + t for t in texts[:3]])
    pairs, n_pair = np.unique(both, return_counts=True)
    count = np.bincount(np.concatenate(texts[:3]), minlength=size).astype(float)
    m = pickle.loads(pickle.dumps(at.Attention(texts, count, pairs, n_pair, begin, epochs=1)))
    ids, bounds = np.concatenate(texts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    d, whole = at.WIDTH, m.score(ids, bounds)
    known = collections.Counter(dict(zip(pairs.tolist(), n_pair.tolist())))

    def inside(prev, x):
        """The share of x among the ids of its class, behind prev."""
        own = [y for y in range(size) if m.cls[y] == m.cls[x]]
        if len(own) == 1:
            return 1.0
        mass = (count[x] + 0.1) / sum(count[y] + 0.1 for y in own)
        return (known[prev * size + x] + at.PRIOR * mass) / (sum(known[prev * size + y] for y in own) + at.PRIOR)

    for k, t in enumerate(texts):
        before, total = np.concatenate([[begin], t[:-1]]), 0.0
        for i in range(len(t)):
            start = 0 if i < at.WINDOW else (1 + (i - at.WINDOW) // at.STRIDE) * at.STRIDE
            x = m.by_id[m.row[before[start : i + 1]]] + m.by_place[: i + 1 - start]
            a = np.exp(x[:, d : 2 * d] @ x[-1, :d])
            out = m.w["e"][m.row[before[i]]] + (a / a.sum()) @ x[:, 2 * d : 3 * d] @ m.w["o"]
            group, slot = divmod(int(m.cls[t[i]]), at.IN_GROUP)
            share = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            p = share(out @ m.w["u"] + m.to_group[m.row[before[i]]])[group] * share(out @ m.w["c"][group] + m.to_class[m.row[before[i]], group])[slot]
            total += np.log10(p) + np.log10(inside(before[i], t[i]))
        assert math.isclose(whole[k], total, rel_tol=1e-4)
    assert all(math.isclose(sum(inside(prev, y) for y in range(size)), len(set(m.cls.tolist())), rel_tol=1e-6) for prev in (begin, int(texts[0][0]), 298))
    s, n, skip = at.windows(bounds)
    assert (n - skip).sum() == len(ids)


def test_attention_beats_word_counts(spark):
    """On held-out texts of the documents the attention model is better than the word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    got = lm_score.score(docs, ~held).join(docs.select("doc_id", held.alias("held")), "doc_id").where("held").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scored_ids_have_context():
    """Every id is scored once, and in a later window with at least a quarter of the window before it."""
    from geolake.llm import attention as at

    for n in (1, 31, 32, 33, 56, 57, 200):
        start, length, skip = at.windows(np.array([0, n]))
        scored = [i for s, m, k in zip(start, length, skip) for i in range(s + k, s + m)]
        assert scored == list(range(n)) and all(k >= at.WINDOW // 4 for k in skip[1:])


def test_attention_learns_from_every_text(spark, texts):
    """Beyond the first round too: every id that stands before another moves its row; and the classes are those of all pairs, however many the table holds."""
    from geolake.llm import attention as at

    docs = make(spark, texts + [f"lone{i} qz{i}x {'word ' * 40}" for i in range(300)])
    pairs = lm_score.counts_of(docs).where(F.col("kind") == lm_score.TWO_IDS).select("key", "n")
    few = lm_score.fit_attention(docs, pairs, 300, most_pairs=40)
    whole = sorted((r.key, r.n) for r in pairs.collect())
    key, n = (np.array(x) for x in zip(*whole))
    start = at.Attention([], np.bincount(key % lm_score.SIZE, n, lm_score.SIZE), key, n, lm_score.END)
    assert (few.cls == start.cls).all() and (few.behind == start.behind).all()
    moved = (few.w["e"] != start.w["e"]).any(1)
    assert moved[start.row[np.unique(key // lm_score.SIZE)]].all()
    # several parts a round: their average, and the same once more
    parts = [lm_score.fit_attention(docs, pairs, 300, part=1000) for _ in range(2)]
    assert (parts[0].flat() == parts[1].flat()).all() and (parts[0].flat() != lm_score.fit_attention(docs, pairs, 300).flat()).any()


def test_attention_is_fitted_on_stored_ids(spark, texts):
    """Texts that were encoded once aren't encoded again: the fit is the same, and needs no vocabulary."""
    docs = make(spark, [*texts, None, ""])
    ids = lm_score.stored(lm_score.coded(docs), "ids")
    found = lm_score.counts_of(docs, texts=ids)
    assert sorted(found.collect()) == sorted(lm_score.counts_of(docs).collect())
    pairs = found.where(F.col("kind") == lm_score.TWO_IDS).select("key", "n")
    assert (lm_score.fit_attention(docs, pairs, 300, vocabulary_path="/nowhere", texts=ids).flat() == lm_score.fit_attention(docs, pairs, 300).flat()).all()


def test_copies_have_one_score(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (3, "")], "doc_id long, text string")
    got = lm_score.score(docs, F.coalesce(F.col("doc_id") != 2, F.lit(True))).collect()
    assert len(got) == 6 and len({r.score for r in got if r.n_tokens == 4}) == len({r.score for r in got if r.n_tokens == 1}) == 1 and sum(r.n_tokens == 4 for r in got) == 4


def test_new_pieces_are_encoded_together(monkeypatch):
    """Pieces behind a blank share texts that go to the tokenizers library, and have the ids of its own encoding."""
    import public_tokenizers

    plain = " ".join(f"wörd{i} it's (no.{i}) é{i}, a-{i}" if i % 3 else f"plain{i}\nnext É" for i in range(700))
    for name, keeps_space in tokens.KEEPS_SPACE.items():
        enc, sent = tokens.Encoder(public_tokenizers.path(name), keeps_space), []
        whole = enc.whole
        monkeypatch.setattr(enc, "whole", lambda x, whole=whole, sent=sent: sent.append(len(x)) or whole(x))
        for t in (plain, plain.replace("é", "Ġ").replace("wö", "<|endoftext|>"), plain.title()):
            (_, _, ids, _), *_ = enc.encode(pa.array([t]), 7)
            assert ids.tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 7]
        assert not keeps_space or sum(sent) < len(enc.keys) / 2
