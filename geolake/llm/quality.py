"""Quality rules with risk-controlled thresholds.

Every rule is a number of a document that is high in poor text. On a quarter of the labelled documents rules are chosen one
after the other, each by what it gains over documents that those before it don't reject, until none gains; the other documents
are the holdout on which the cutoffs of all chosen rules are selected for each stratum (language). There cutoffs are tried from the most lenient on, and one is certified while the exact binomial tail says
that the rule rejects no more than its part of the allowed share of good documents. Testing in this fixed order needs no
correction over cutoffs; the error level is divided by the number of strata and rules (Bonferroni) and the allowed share by
the number of rules, so with probability 1 - DELTA the rules together reject at most ALPHA of the good documents that pass the base rule in every stratum.
Among certified cutoffs the one that gains most is taken; a rule without one rejects nothing in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, stored, table, text_buffer, words

ALPHA = 0.01
DELTA = 0.05
BINS = 200
#: A good document that is lost weighs as much as so many poor ones that are caught, each as a share of its kind.
LOSS = 10.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_distinct long"
_NAMES = [x.split()[0] for x in SIGNALS.split(", ")]
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_UP = np.zeros(256, bool)
_UP[65:91] = True
_AZ = _UP.copy()
_AZ[97:123] = True


def measure(column: pa.Array) -> list[np.ndarray]:
    """The SIGNALS of every row of a text column; a null text counts as empty and gives zeros."""
    out = [np.zeros(len(column), np.int64) for _ in _NAMES]
    n_words, word_chars, n_symbols, n_dup, n_rep, n_lines, n_upper, n_letters, n_distinct = out
    whole, whole_at = text_buffer(column)
    for lo, hi in blocks(whole_at):
        buf, at = whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo]
        if not len(buf):
            continue
        s, e, h, bound = words(buf, at, fold=False)
        n_words[lo:hi] = np.diff(bound)

        def per_row(mask: np.ndarray, at=at) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[at[1:]] - total[at[:-1]]

        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        word_chars[lo:hi] = per_row(~space & ((buf & 0xC0) != 0x80))
        n_symbols[lo:hi], n_upper[lo:hi], n_letters[lo:hi] = per_row(_SYM[buf]), per_row(_UP[buf]), per_row(_AZ[buf])
        if len(h) >= WINDOW:
            win = np.zeros(len(h) - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                win = mix(win + h[k : len(h) - WINDOW + 1 + k])
        data = buf.tobytes()
        for i in range(hi - lo):
            a, b = int(bound[i]), int(bound[i + 1])
            if a == b:
                continue
            lines = [x for x in data[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
            n_lines[lo + i] = len(lines)
            n_dup[lo + i] = len(lines) - len(set(lines))
            own = np.sort(h[a:b])
            n_distinct[lo + i] = 1 + np.count_nonzero(own[1:] != own[:-1])
            if b - a > WINDOW:
                w = win[a : b - WINDOW + 1]
                t = np.sort(w)
                twice = t[1:][t[1:] == t[:-1]]
                if len(twice):
                    near = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
                    starts = np.flatnonzero(twice[near] == w)
                    step = np.zeros(b - a + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + WINDOW, -1)
                    n_rep[lo + i] = np.count_nonzero(np.cumsum(step))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row = b.column("row")
        text = row.field("text")
        if row.offset or len(text) != len(row):
            text = text.slice(row.offset, len(row))
        yield pa.RecordBatch.from_arrays([row, *map(pa.array, measure(text))], ["row", *_NAMES])


def signals(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs) and its SIGNALS. Clashing names cannot meet, as the input stays inside `row`."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return d.mapInArrow(_measured, f"row {d.schema['row'].dataType.simpleString()}, {SIGNALS}")


def rules() -> dict[str, Column]:
    """Numbers from 0 to 1 that are high in poor text."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    mean = share("word_chars", "n_words")
    return {
        "symbols": F.least(share("n_symbols", "word_chars"), F.lit(1.0)),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "n_letters"),
        "long_words": F.least(mean / 40, F.lit(1.0)),
        "short_words": F.when(F.col("n_words") > 0, F.lit(1.0) - F.least(mean / 10, F.lit(1.0))).otherwise(1.0),
        "few_words": F.lit(1.0) / (F.lit(1.0) + F.col("n_words") / 10.0),
        "same_words": F.lit(1.0) - F.when(F.col("n_words") > 0, share("n_distinct", "n_words")).otherwise(1.0),
    }


def _bin(score: Column) -> Column:
    return F.least(F.floor(score * BINS), F.lit(BINS - 1)).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), exactly."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    return min(1.0, float(np.exp(math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certify(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, loss: float = LOSS) -> int | None:
    """The cut bin (documents of this bin and above are rejected) that gains most among the certified ones, or None.

    good, bad: counts by bin. Bins are tried from the top; the first that isn't certified ends the search.
    """
    n, m = int(good.sum()), int(bad.sum())
    if not n:
        return None
    best, chosen = 0.0, None
    for cut in range(len(good) - 1, 0, -1):
        k = int(good[cut:].sum())
        if binomial_tail(k, n, alpha) > delta:
            break
        gain = bad[cut:].sum() / max(m, 1) - loss * k / n
        if gain > best + 1e-12:
            best, chosen = gain, cut
    return chosen


def _choosing() -> Column:
    """A quarter of the ids, by the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 4 == 0


def _counts(labelled: DataFrame, *by: str) -> list:
    """Rows of by, good, rule, bin and count: some thousands for each value of `by` at most."""
    scores = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("bin")) for k in rules()])).alias("x")
    return labelled.select(*by, "good", scores).groupBy(*by, "good", "x.rule", "x.bin").count().collect()


def choose(labelled: DataFrame) -> list[str]:
    """Rules in the order in which they gain most (ties: by name) over the documents that the rules before them leave.

    labelled: good and a bin for each rule. A gain counts shares of all documents; every round is one aggregation.
    """
    chosen: list[str] = []
    whole = None
    while len(chosen) < len(rules()):
        counts: dict[str, np.ndarray] = {}
        for r in _counts(labelled):
            counts.setdefault(r["rule"], np.zeros((2, BINS), np.int64))[int(r["good"]), r["bin"]] += r["count"]
        if not counts:
            break
        if whole is None:
            whole = np.maximum(1, next(iter(counts.values())).sum(1))
        best, rule, cut = 0.0, None, 0
        for name in sorted(counts.keys() - set(chosen)):
            bad, good = np.cumsum(counts[name][:, ::-1], axis=1)[:, ::-1] / whole[:, None]
            gain = bad - LOSS * good
            at = BINS - 1 - int(gain[:0:-1].argmax())  # the most lenient of equal cutoffs
            if gain[at] > best + 1e-12:
                best, rule, cut = float(gain[at]), name, at
        if rule is None:
            break
        chosen.append(rule)
        labelled = labelled.where(F.col(rule) < cut)
    return chosen


def learn(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """Cut bins by stratum and rule, from documents with a label (several labels of a document: the lowest quality).

    measured: doc_id, stratum and SIGNALS; what the base rule rejects teaches nothing. Only counts come to the driver: BINS x rules x strata x kinds rows at most, and a round of choosing needs no strata. The
    stratum "" pools all documents and serves strata without labels.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    d = measured.where(~base_failed()).join(lab, "doc_id")
    d = stored(d.select("stratum", (F.col("quality") > 0).alias("good"), _choosing().alias("choosing"), *[_bin(v).alias(k) for k, v in rules().items()]), "labelled")
    chosen = choose(d.where("choosing"))
    counts: dict[tuple[str, str], np.ndarray] = {}
    for r in _counts(d.where("not choosing"), "stratum"):
        for stratum in {r["stratum"], ""}:
            counts.setdefault((stratum, r["rule"]), np.zeros((2, BINS), np.int64))[int(r["good"]), r["bin"]] += r["count"]
    strata = sorted({s for s, _ in counts})
    cuts: dict[str, dict[str, int]] = {s: {} for s in strata}
    for stratum in strata:
        for rule in chosen:
            bad, good = counts.get((stratum, rule), np.zeros((2, BINS), np.int64))
            if (cut := certify(good, bad, alpha / len(chosen), delta / (len(strata) * len(chosen)))) is not None:
                cuts[stratum][rule] = cut
    return cuts


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def rejected_by(cuts: dict[str, dict[str, int]], stratum: Column) -> Column:
    """The rules that reject a document, as a sorted array of names."""
    names = sorted(rules())
    hits = []
    for name in names:
        by = {s: c[name] for s, c in cuts.items() if name in c}
        cut = F.when(stratum.isin([s for s in cuts if s]), F.lit(None).cast("int"))
        for s, c in by.items():
            cut = F.when(stratum == s, F.lit(c)).otherwise(cut) if s else cut
        cut = F.when(stratum.isin([s for s in cuts if s]), cut).otherwise(F.lit(by.get("")).cast("int"))
        hits.append(F.when(_bin(rules()[name]) >= cut, F.lit(name)))
    return F.array_compact(F.array(*hits))


def _stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept of every row.

    A null or empty text has no words and fails the base rule. Without labels nothing but the base rule rejects. A null
    language is judged by the pooled cutoffs. Repeated rows are judged each for itself, very long texts whole. Of rules that gain equally the
    first by name is chosen. Extra columns are not read; an empty table gives no rows.
    """
    d = stored(signals(docs.select("doc_id", "text", "lang")).select("row.doc_id", _stratum(F.col("row.lang")).alias("stratum"), *_NAMES), "signals")
    cuts = learn(d, labels, alpha, delta)
    d = d.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected_by(cuts, F.col("stratum")))
    return d.select("doc_id", *_NAMES[:5], "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns and no shuffle of texts. Repeated rows stay repeated; a null doc_id
    teaches nothing and is judged like others; names of columns can't clash, as rows travel inside a struct."""
    d = signals(docs).withColumn("stratum", _stratum(F.col("row.lang")))
    cuts = learn(stored(d.select("row.doc_id", "stratum", *_NAMES), "signals"), labels, alpha, delta)
    return d.where(~base_failed() & (F.size(rejected_by(cuts, F.col("stratum"))) == 0)).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("rejected_by", F.array_join("rejected_by", ","))
