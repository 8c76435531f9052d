"""Filter audit, line dedup and hard negatives against brute force, on tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from geolake.llm import audit, line_dedup, negatives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, key string, line int, part string, n long, seen boolean"


def rows_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, 1, 9, "k", 3, "p", 5, True) for i, t, s in rows], schema)


# -- filter audit ---------------------------------------------------------------------------------------------------


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = []
    for i, t, s in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        failed.append((s or "", failures(t or "") + ("E" if copy else ""), i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {f[0] for f in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in failed if f[0] == part]
            for step, x in enumerate(order, 1):
                fails = [f for f in left if x in f[1]]
                everyone = [f for f in failed if f[0] == part and x in f[1]]
                left = [f for f in left if x not in f[1]]
                out[part, order, step] = [len(left), len(fails), len(everyone) - len(fails), sum(f[1] == x for f in everyone), sum(f[2] for f in fails), sum(f[3] for f in fails), x]
                shapley[part, x] += len(fails)
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def audited(spark, rows, labels):
    d = audit.audit(rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = d.collect()
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)
    table = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(table) == len(got)
    return table


def test_audit(spark):
    rng = random.Random(3)
    words = ["Ab", "cd", "é", "XY", "z#", "über", "x", "w1", "w2"]
    rows = [(i, " ".join(rng.choices(words if i % 3 else [f"v{k}" for k in range(500)], k=rng.choice([3, 150, 199, 200, 230, 300]))), rng.choice(["a", "a", "b", None, ""])) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1], rng.choice("abc")) for i in range(40)] + [(i, None, "a") for i in (7, 300, 301)] + [(302, "", "b"), (303, " \t\n", None)]
    rows += [rows[5], rows[5], (201, "other text", "a"), (None, rows[3][1], "a"), (None, None, None), (-4, rows[9][1], "n"), (400, "long " * 30_000, "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)
    assert audited(spark, rows[:3], []) == brute_audit(rows[:3], [])
    assert audited(spark, [], labels) == {}


def test_audit_shuffles_no_text(spark):
    """Texts end at the scan's projection, and hot texts are counted before they are gathered."""
    plan = audit.cells(rows_of(spark, [(1, "a", "s")]), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


# -- line dedup -----------------------------------------------------------------------------------------------------


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(rows, chars=40, docs=5):
    held = collections.defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n") if i is not None else []:
            held[key_of(line)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key_of(x)) < chars or len(held[key_of(x)]) < docs or i == max(held[key_of(x)])]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def line_rows(rng, n):
    common = ["Common Line Number %d with Éé and padding to pass forty" % k for k in range(6)] + ["x" * 39, "y" * 40, "Ä" * 40, " " + "z" * 39]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) for _ in range(rng.randint(0, 4))] + ["own line %d %d which is long enough to be a key of its own" % (i, k) for k in range(2)] + ["", "short"]
        rng.shuffle(lines)
        rows.append((rng.randrange(-5, 10**6), "\n".join(rng.choice(["", " ", "\t\v"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r"]) for x in lines), "s"))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    rows = line_rows(rng, 60)
    hot = "this line is in every one of very many documents"
    rows += [(2_000_000 + i, f"{hot}\nb{i}\n{hot}", "s") for i in range(30)] + [(i, None, "s") for i in (1, 2)] + [(3, "", "s"), (4, "\n\n", "s")]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], "s"), (None, f"{hot}\n{rows[2][1]}", "s"), (None, None, "s")]
    rows += [(5_000_000, "\n".join([hot, *(f"line {k % 700} of a very long text, with enough letters" for k in range(20_000))]), "s")]
    got = line_dedup.dedup(rows_of(spark, rows), batches=batches)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("runs_")]


def test_line_dedup_edges(spark):
    assert line_dedup.dedup(rows_of(spark, [])).count() == 0
    assert [(r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(rows_of(spark, [(None, None, None)])).collect()] == [(1, 0, "")]
    # all lines of all documents but one go; four documents are too few
    line = "one and the same line, which is long enough to count"
    for n in (4, 5):
        rows = [(i, line, "s") for i in range(n)]
        assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup(rows_of(spark, rows)).collect()) == brute_lines(rows)


def test_runs_are_merged_without_shuffling_them(spark):
    """A batch meets the runs in merge joins; the runs are not shuffled, and compacting two runs shuffles nothing."""
    from pyspark.sql import functions as F

    runs = line_dedup.Runs(spark)
    for b in range(3):
        runs.add(spark.range(b * 50, b * 50 + 100).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("key"), F.lit(1).cast("long").alias("docs"), F.lit(9 - b).cast("long").alias("top")))
        assert runs._held(runs.batches[-1]).count() == (50 if b else 100)
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 1]
    both = runs._held(runs.levels[0][0]).unionByName(runs._held(runs.levels[1][0]))
    assert both.count() == 200
    plan = both.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    own = spark.table(runs.batches[0]).select("key").join(runs._held(runs.levels[1][0]).select("key", F.lit(1).alias("x")).hint("merge"), "key", "left")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    counts = {r.docs for r in runs.frequent(2).collect()}
    assert counts == {2} and runs.frequent(1).count() == 200
    runs.drop()


# -- hard negatives -------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score long, slot long"


def brute_negatives(rows, positives=5, wanted=10):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        q = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        best[i] = min(best.get(i, q), q)
    out = []
    for a, (la, va) in best.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [(x, i) for x, i, label in scored if label != la and 30 * -s <= 100 * -x <= 90 * -s][:wanted]
            out += [(a, p, k, i, -s, -x) for k, (x, i) in enumerate(fits, 1)]
    return sorted(out)


def vector_rows(rng, n, width=16, scale=0.3):
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, scale / 2))) for x in c], rng.randrange(10)))
    return rows


def mined(spark, rows, **options):
    from pyspark.sql import functions as F

    got = negatives.mine(spark.createDataFrame([(*r, 7, 7) for r in rows], VECTORS).repartition(5), F.col("vec_id") % 100 == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def test_negatives(spark, monkeypatch):
    rng = random.Random(8)
    rows = vector_rows(rng, 900)
    odd = [(None, rows[0][1], 1), (901, None, 1), (902, rows[1][1], None), (903, [*rows[2][1][:-1], None], 2), (904, [float("nan")] * 16, 2), (905, [float("inf")] * 16, 3), (1000, [], 4), (906, rows[5][1][:9], 4)]
    odd += [rows[11], rows[11], (12, rows[13][1], 3), (-100, rows[14][1], 5), (-7, rows[15][1], -1), (1100, [0.0] * 16, 2), (907, [x * 4000 for x in rows[6][1]], 6)]
    odd += [(2000 + k, rows[20][1], k % 10) for k in range(60)]  # ties
    want = brute_negatives(rows + odd)
    assert len(want) > 200 and mined(spark, rows + odd) == want
    # small blocks and steps: several blocks of anchors, many batches in a task
    monkeypatch.setattr(negatives, "PAIRS", 640)
    assert mined(spark, rows + odd, block_bytes=600) == want
    assert mined(spark, rows, positives=2, negatives=3) == brute_negatives(rows, 2, 3)


def test_negatives_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1)]) == [] == mined(spark, [(100, [0.5], 1)])
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(100 * k, [3e15, 1.0], 1) for k in range(3)])


def test_planes_drop_pairs():
    """Most pairs leave before the last plane, and what is kept is exact."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(0, 0.2, (4000, 64))).astype(np.int64)
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    a = ids[::100]
    slots = (np.arange(len(a)), np.full(len(a), -np.inf), np.full(len(a), np.inf))
    bits = int(np.abs(v).max()).bit_length() + 1
    p = negatives.Planes(v[a], a, labels[a], slots, bits, True, 5)
    for i in range(0, 4000, 1000):
        p.add(ids[i : i + 1000], labels[i : i + 1000], v[i : i + 1000])
    exact = v[a] @ v.T
    for slot, score, row in zip(*p.found):
        assert exact[slot, row] == score
    for k in range(len(a)):
        order = np.lexsort((ids, -exact[k]))
        order = order[order != a[k]][:5]
        mine = p.found[2][p.found[0] == k]
        assert mine.tolist() == order.tolist()
    assert p.looked < 0.8 * bits * len(a) * 4000


def test_contract_digests(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a\nb", "s"), (2, None, "s")]
    got = line_dedup.dedup(rows_of(spark, rows)).select("doc_id", F.sha2("text", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
