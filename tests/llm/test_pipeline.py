"""The pipeline's stages, one after the other, against brute force on whole small tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.llm import oracles, tokens

from .test_ops import brute_leaks, prose, shingles, split

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from geolake.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_shape(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    for before, after in itertools.pairwise(stages[:-1]):
        a, b = rows(before), rows(after)
        assert b.items() <= a.items() and len(b) == after.count()


def test_quality_stage(spark, stages):
    """Few labels certify no cutoff here, so the base rule alone rejects; larger tables are held against SQL by the driver."""
    want = set()
    for i, r in rows(stages[0]).items():
        w = split(r.text)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(5)}
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            want.add(i)
    assert set(rows(stages[1])) == want and "op8_quality" in oracles.ORACLES


def test_language_stage(stages):
    """All texts have letters and are in a language that was learned."""
    assert set(rows(stages[2])) == {i for i, r in rows(stages[1]).items() if re.search(r"[^\W\d_]", r.text or "")}


def test_near_dedup_stage(stages):
    docs = sorted(rows(stages[2]).items())
    sets = {i: shingles(r.text, 2) for i, r in docs}
    own = {i: i for i, _ in docs}
    links = [(i, j) for (i, _), (j, _) in itertools.combinations(docs, 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in docs:
        for i, j in links:
            own[i] = own[j] = min(own[i], own[j])
    assert links and set(rows(stages[3])) == {i for i in own if own[i] == i}


def test_decontamination_stage(spark, stages):
    docs = sorted(rows(stages[3]).items())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {docs[d][0] for d, _ in brute_leaks([r.text for _, r in docs], items)}
    assert bad and set(rows(stages[4])) == {i for i, _ in docs} - bad


def test_packing_stage(stages):
    enc = tokens.encoder("byte_bpe_50k.json")
    got = collections.defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id].append(r)
    docs = rows(stages[4])
    assert got.keys() == docs.keys()
    for i, r in docs.items():
        ids, at = [*enc.whole([r.text])[0], 2], 0
        for p in sorted(got[i], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    room = collections.Counter()
    for p in itertools.chain.from_iterable(got.values()):
        room[p.sequence_id] += p.length
    assert max(room.values()) <= 1024 and len(room) <= 1.05 * sum(room.values()) / 1024 + 1


def odd_rows(spark, n=12):
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts, and names that operators use inside."""
    rng = random.Random(21)
    good = [prose(rng, 60) for _ in range(n)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(0, good[0], "en", "s", 1), (1, good[5], "en", "s", 2), (2, prose(rng, 70), None, None, None)]
    rows += [(None, good[3], "en", "s", 3), (None, None, None, None, None), (50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, " \n ", None, "s", 0), (53, prose(rng, 20_000), "en", "s", 9), (53, "12 34 " * 20, "en", "s", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(1) for c in ("row", "node", "rows", "kept", "rep", "n", "hub", "part", "length", "word", "similarity", "lang_pred", "score", "piece", "words")})


def test_stages_take_odd_tables(spark):
    import corpus_pipeline

    d = odd_rows(spark)
    whole = collections.Counter((r.doc_id, r.text) for r in d.collect())
    out = {name: stage(spark, d, SF) for name, stage in corpus_pipeline.STAGES}
    for name, df in out.items():
        if name == "best_fit_packing":
            assert df.where("piece = 0").count() == d.count()
            continue
        assert df.columns == d.columns
        got = collections.Counter((r.doc_id, r.text) for r in df.collect())
        assert got <= whole, name
        gone = whole - got
        if name == "near_dedup":  # repeats of a row and copies go, rows without an id or words stay
            assert got[0, d.first().text] == 1 and all(got[k] == n for k, n in whole.items() if k[0] is None or not (k[1] or "").split()) and len([k for k in got if k[0] in (2, 53)]) == 4
        elif name == "quality_rules":
            assert all(not t or len(t.split()) < 10 or "12 34" in t for _, t in gone) and (50, None) in gone
        elif name == "language_id":
            assert {t for _, t in gone} == {None, "", " \n ", "12 34 " * 20}
        else:
            assert not gone
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0, name


def test_operators_take_odd_tables(spark):
    """One row a document, whatever its columns hold; nothing from an empty table."""
    from geolake.llm import decontam, langid, licenses, lm_score, minhash, quality, sharding

    d, bench = odd_rows(spark), spark.createDataFrame([(1, None), (None, "a b c d e f g h")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, None, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    run = {
        "near-duplicates": minhash.link, "licenses": licenses.scan, "shards": sharding.shard, "languages": lambda x: langid.identify(x, langid.train(x)), "quality": lambda x: quality.judge(x, labels),
        "scores": lambda x: lm_score.score(x, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True))),
    }
    ids = sorted(d.select("doc_id").collect(), key=str)
    for name, f in run.items():
        assert sorted(f(d).select("doc_id").collect(), key=str) == ids, name
        assert f(d.limit(0)).count() == 0, name
    assert decontam.leaks(d, bench).count() == 0


def test_token_files_take_odd_tables(spark, tmp_path):
    """Null ids come first, rows of one id stand in the order of their texts, every row is there, and starts add up over files."""
    from geolake.llm import token_files

    d = odd_rows(spark)
    token_files.write_tokens(d, f"{tmp_path}/odd")
    enc, want, at = tokens.encoder(token_files.VOCABULARY), [], 0
    for i, t in sorted(((r.doc_id, r.text) for r in d.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*enc.whole([t or ""])[0], token_files.END]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda x: (x[1], str(x))
    assert sorted((tuple(r) for r in token_files.token_index(spark, f"{tmp_path}/odd").select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key) == want
    assert token_files.read_tokens(spark, f"{tmp_path}/odd", 53, 53).count() == 2
    token_files.write_tokens(d.limit(0), f"{tmp_path}/none")
    assert token_files.token_index(spark, f"{tmp_path}/none").count() == 0


def test_pages_take_odd_tables(spark):
    """One row a page, also for null ids, addresses and pages; repeated rows have equal results; a long page is whole; other columns aren't read."""
    from geolake.llm import html_text

    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    rng = random.Random(5)
    many = [prose(rng, 40) for _ in range(3000)]
    long = "<html><body><div id='menu'><a href='/'>Home</a></div><article>" + "".join(f"<p>{x}.</p>" for x in many) + "</article></body></html>"
    odd = [(None, None, None), (7, None, ""), (8, "http://a.example/x", "<p class="), (None, "not a url", given[0][2]), given[1], given[1], (given[1][0], given[1][1], given[2][2]), (9, "http://a.example/long", long)]
    d = spark.createDataFrame(given + odd, "page_id long, url string, html string")
    d = d.withColumns({c: F.lit(1) for c in ("text", "n_chars", "host", "model", "labels")})
    got = collections.Counter((r.page_id, r.url, r.text) for r in html_text.extract_pages(d).collect())
    assert sum(got.values()) == len(given) + len(odd)
    assert {(i, t) for i, u, t in got if u in (None, "http://a.example/x")} == {(None, ""), (7, ""), (8, "")}
    assert got[9, "http://a.example/long", "\n\n".join(f"{x}." for x in many)] == 1
    same = {t for (i, u, t) in got if (i, u) == given[1][:2]}
    assert len(same) == 2 and {t for (i, u, t) in got if u == "not a url"} == {t for (i, u, t) in got if (i, u) == given[0][:2]}
    assert html_text.extract_pages(d.limit(0)).count() == 0


def test_leaks_in_odd_tables(spark):
    """Items that stand in odd rows are found in each of them, nothing else; repeated items count each for itself."""
    from geolake.llm import decontam

    d = odd_rows(spark)
    docs = [(r.doc_id, r.text) for r in d.collect()]
    items = [(1, docs[3][1]), (2, " ".join(docs[5][1].split()[10:40])), (None, docs[0][1]), (2, " ".join(docs[5][1].split()[10:40])), (4, None), (5, ""), (6, " ".join(next(t for i, t in docs if i == 53).split()[500:540]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "similarity", "n")})
    want = collections.Counter((docs[a][0], items[b][0]) for a, b in brute_leaks([t for _, t in docs], [t for _, t in items]))
    assert sum(want.values()) == 9 and collections.Counter((r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()) == want
    kept = collections.Counter((r.doc_id, r.text) for r in decontam.keep(d, bench).collect())
    bad = {a for a, _ in brute_leaks([t for _, t in docs], [t for _, t in items])}
    assert kept == collections.Counter(x for k, x in enumerate(docs) if k not in bad)


def test_run(spark, stages):
    import corpus_pipeline

    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5].collect()))


def test_oracles(spark):
    """The SQL of this subpackage gives the queries' rows."""
    import duckdb

    from geolake.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in oracles.ORACLES.items():
        want, df = con.sql(sql), QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        canon = lambda rs, names: sorted(str([r[names.index(c)] for c in cols]) for r in rs)
        assert sorted(want.columns) == cols and canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns), name
