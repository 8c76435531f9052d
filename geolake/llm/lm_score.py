"""Language-model scores of whole texts: a causal self-attention model over subword ids, and a word-count baseline.

The counts of all words, subword ids and pairs of ids of all training texts come from one pass: tasks count their own, a shuffle adds
the counts up. The attention model (attention.py) rests on the counts of ids and of all pairs, which choose its classes of ids too. Its weights
are fitted in numpy on all training texts, in rounds: the first FIRST_IDS ids (by the texts' hashes) are one task's; each round after that
takes up to GROWTH times the ids before it, in parts of about PART_IDS, which tasks learn from apart, and averages what they come to.
Scoring looks the FREQUENT most frequent
words and the PAIRS most frequent pairs up in broadcast tables of fixed size and leaves the others of each text as keys; these are joined
with the counts by a shuffle, so words and pairs may outgrow any one machine. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import CLASSES, FIRST, LATER, NEAR, PROFILE, WIDTH, Attention, alike, classes, clusters, neighbours, rows_of
from .common import blocks, crc_of_id, stored, table, text_buffer, words
from .tokens import BLOCK, encoder

VOCABULARY = "byte_bpe_50k.json"
SIZE, END = 50257, 50256
#: Ids in the first round of the attention's fit, which goes over them EPOCHS times, how much more the next rounds take, and ids in a part of
#: these. Every training text is in one round.
FIRST_IDS, EPOCHS, GROWTH, PART_IDS = 1_200_000, 2, 16, 4_000_000
#: Ids that a task holds at once while it learns (more if a text is longer), and rows of weights in a row of a part's result.
HELD_IDS, CHUNK = 250_000, 64
#: Pairs of ids and words in tables of fixed size; the others are joined.
PAIRS, FREQUENT = 1_000_000, 200_000
SMOOTHING = 0.1
#: Stands for the end of a text among the words' hashes.
END_WORD = np.int64(0x2545F4914F6CDD1D)


#: Kinds of counted things.
WORDS, TWO_IDS = 0, 1


def _coded(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The columns of a batch, with the texts' ids in 16 bits, the end behind them, in the place of `text`."""
        enc = encoder(name, path)
        for b in batches:
            rest = [i for i, n in enumerate(b.schema.names) if n != "text"]
            for lo, hi, ids, at in enc.encode(b.column("text"), END):
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at * 2), pa.py_buffer(ids.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in rest), data.cast(pa.binary())], [*(b.schema.names[i] for i in rest), "ids"])

    return run


def _same_text() -> list[Column]:
    """Two 64-bit hashes of a row, by which what was found from its ids and from its words meets; the first deals texts into rounds and parts too."""
    return [F.xxhash64("text", "doc_id").alias("spread"), F.xxhash64(F.lit(1), "doc_id", "text").alias("other")]


def coded(docs: DataFrame, vocabulary: str = VOCABULARY, vocabulary_path: str | None = None, train: Column | None = None) -> DataFrame:
    """(spread, other, train, filled, ids) of every row of `docs`: its ids in 16 bits with the end behind them (null: the end alone)."""
    rows = docs.select(*_same_text(), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"), F.col("text").isNotNull().alias("filled"), "text")
    return rows.mapInArrow(_coded(vocabulary, vocabulary_path), "spread long, other long, train boolean, filled boolean, ids binary")


def _id_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, bounds of the rows in ids) of coded() rows, about HELD_IDS ids at once."""
    whole, whole_at = text_buffer(column)
    for lo, hi in blocks(whole_at, 2 * HELD_IDS):
        yield lo, hi, whole[whole_at[lo] : whole_at[hi]].view(np.uint16), (whole_at[lo : hi + 1] - whole_at[lo]) // 2


def _count(kind: int, keys_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, key, n) of the rows of a partition; counts are given out whenever many have come together."""
        keys, held, texts = [], 0, 0

        def out() -> pa.RecordBatch:
            code, unique = pd.factorize(np.concatenate([k for k, _ in keys] + [np.zeros(0, np.int64)]))
            n = np.bincount(code, np.concatenate([c for _, c in keys] + [np.zeros(0)]), len(unique)).astype(np.int64)
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), kind, np.int32)), pa.array(unique), pa.array(n)], ["kind", "key", "n"])

        for b in batches:
            texts += len(b)
            for key in keys_of(b.column(0)):
                code, unique = pd.factorize(key)
                keys.append((unique, np.bincount(code, minlength=len(unique))))
                held += len(unique)
                if held > 3_000_000:
                    yield out()
                    held = 0
        if kind == WORDS:
            keys.append((np.array([END_WORD]), np.array([texts])))
        yield out()

    return run


def _words_of(column: pa.Array) -> Iterator[np.ndarray]:
    whole, whole_at = text_buffer(column)
    for lo, hi in blocks(whole_at, BLOCK):
        yield words(whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo])[2].view(np.int64)


def _pairs_of(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, ids, at in _id_blocks(column):
        ids = ids.astype(np.int64)
        before = np.concatenate([[END], ids[:-1]])
        before[at[:-1]] = END
        yield before * SIZE + ids


def counts_of(train: DataFrame, vocabulary: str = VOCABULARY, vocabulary_path: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(kind, key, n): how often each word, by its hash, and the end occur in the texts of `train` (null: the end alone), and each pair of subword
    ids (the end stands before a text and after it), as id before * SIZE + id. texts: coded() of them, if it is at hand."""
    texts = coded(train, vocabulary, vocabulary_path) if texts is None else texts
    found = [rows.mapInArrow(_count(kind, keys), "kind int, key long, n long") for kind, keys, rows in ((WORDS, _words_of, train.select("text")), (TWO_IDS, _pairs_of, texts.select("ids")))]
    return found[0].unionByName(found[1]).groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")


class _Frequent:
    """Hashes of the most frequent words in ascending order, and their counts."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray):
        order = np.argsort(words_)
        self.words, self.counts = words_[order], counts[order]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], 0)


def _based(shared, total: int, vocabulary: int):
    unit = np.log10(total + SMOOTHING * (vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of words and the baseline of every text, and the words that aren't in the table."""
        frequent = shared.value
        end_count = int(frequent.look_up(np.array([END_WORD]))[0])
        for b in batches:
            whole, whole_at = text_buffer(b.column("text"))
            for lo, hi in blocks(whole_at, BLOCK):
                _, _, h, bound = words(whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo])
                code, unique = pd.factorize(h.view(np.int64))
                counts = frequent.look_up(unique)
                value = np.where(counts > 0, np.log10(counts + SMOOTHING) - unit, 0.0)
                n, value = (x[code] if len(unique) else np.zeros(0, np.int64) for x in (counts, value))
                known = np.concatenate([[0], np.cumsum(n > 0)])
                value = np.concatenate([[0.0], np.cumsum(value)])
                n_known = known[bound[1:]] - known[bound[:-1]] + (end_count > 0)
                base = value[bound[1:]] - value[bound[:-1]] + np.log10(end_count + SMOOTHING) - unit
                n_tokens = np.diff(bound) + 1
                rest_at = np.concatenate([[0], np.cumsum(n_tokens - n_known - (end_count == 0))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(rest_at), pa.array(h.view(np.int64)[n == 0]))
                columns = [*(b.column(k).slice(lo, hi - lo) for k in ("doc_id", "spread", "other")), pa.array(n_tokens), pa.array(n_known), pa.array(base), rest]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spread", "other", "n_tokens", "n_known", "base", "rest"])

    return run


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model's score of every row of ids, and the pairs that aren't in its table."""
        model = shared.value
        for b in batches:
            for lo, hi, ids, at in _id_blocks(b.column("ids")):
                known = model.known(ids, at)
                score = model.score(ids, at, known=known)
                rare, rare_at = model.missing(ids, at, known)
                columns = [*(b.column(k).slice(lo, hi - lo) for k in ("spread", "other")), pa.array(score), pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(rare))]
                yield pa.RecordBatch.from_arrays(columns, ["spread", "other", "score", "rare"])

    return run


def _classed(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([classes(*counts.value).astype(np.int32).tobytes()], pa.binary())], ["cls"])

    return run


def _clustered(count):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("cell").to_numpy(), b.column("n").to_numpy()) for b in batches]
        cell, n = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([clusters(count.value, cell, n).astype(np.int32).tobytes()], pa.binary())], ["cls"])

    return run


def _blocks(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint16), np.concatenate([[0], np.cumsum([len(r) // 2 for r in rows])])


def _learned(shared, size: float, how: tuple[int, float, float], epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, part, met, weights) of each part of a partition: what the weights came to, and how often each row was met."""
        rows = ((part, row) for b in batches for part, row in zip(b.column("part").to_pylist(), b.column("ids").to_pylist()))
        for part, own in groupby(rows, lambda r: r[0]):
            model, start = shared.value
            model.put(start)  # a worker may have learned from another part before

            def held(own=own):
                texts, n = [], 0
                for _, row in own:
                    texts.append(row)
                    n += len(row) // 2
                    if n >= HELD_IDS:
                        yield _blocks(texts)
                        texts, n = [], 0
                if texts:
                    yield _blocks(texts)

            texts = held() if epochs == 1 else (b for again in [list(held())] for _ in range(epochs) for b in again)
            met = model.learn(texts, size * epochs, how, np.random.default_rng(part))
            flat = model.flat()
            at = range(0, len(flat), CHUNK)
            columns = [pa.array(np.arange(len(at), dtype=np.int32)), pa.array(np.full(len(at), part, np.int32))]
            columns += [pa.array([x[i : i + CHUNK].tobytes() for i in at], pa.binary()) for x in (met, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "met", "weights"])

    return run


def _averaged(key: tuple, rows: pa.Table) -> pa.Table:
    """Weights of a chunk over all parts, each row by how often the part met it; a row that none met is left as all have it."""
    rows = rows.sort_by("part")
    total, sums = 0.0, 0.0
    for met, weights in zip(rows.column("met"), rows.column("weights")):
        n, w = np.frombuffer(met.as_buffer()), np.frombuffer(weights.as_buffer(), np.float32).reshape(-1, WIDTH)
        total, sums = total + n, sums + n[:, None] * w
    out = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], w).astype(np.float32)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([out.tobytes()], pa.binary())})


def fit_attention(
    train: DataFrame, pairs: DataFrame, first: int = FIRST_IDS, most_pairs: int = PAIRS, vocabulary: str = VOCABULARY, vocabulary_path: str | None = None, part: int = PART_IDS,
    texts: DataFrame | None = None,
) -> Attention:
    """The attention model from the counts of pairs (key, n) of all training texts and, in rounds, from the texts themselves: each of them is
    learned from in one round. The driver gets tables of fixed size: counts of ids, of classes behind ids, of `most_pairs` pairs at
    most, and the averaged weights of a round. texts: coded() of `train`, if it is at hand."""
    spark = train.sparkSession
    count = np.zeros(SIZE)
    for r in pairs.groupBy((F.col("key") % SIZE).alias("id")).agg(F.sum("n").alias("n")).collect():  # at most SIZE rows
        count[r["id"]] = r["n"]
    least = _threshold(pairs, most_pairs)
    top = pairs.where(F.col("n") >= least).select("key", "n").toArrow()
    key, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(key)
    counts = (count, key[order], n[order])
    read = lambda rows: np.frombuffer(rows.first()["cls"], np.int32).astype(np.int64)
    if least <= 1 or not count.any():  # these are all pairs
        shared = spark.sparkContext.broadcast(counts)
        model = Attention([], *counts, END, cls=read(spark.range(0, 1, 1, 1).mapInArrow(_classed(shared), "cls binary")))
    else:
        shared = spark.sparkContext.broadcast(count)
        cls = read(_profiles(pairs, count).repartition(1).mapInArrow(_clustered(shared), "cls binary"))
        behind = _behind(pairs, count, cls)
        near = np.zeros((CLASSES, CLASSES))
        np.add.at(near, cls[rows_of(count, END)], behind)
        new = alike(near.T)
        moved = np.empty_like(behind)
        moved[:, new] = behind
        model = Attention([], *counts, END, cls=new[cls], behind=moved)
    total, done, taken, parts = count.sum(), 0, 0.0, 0
    place = F.pmod(F.col("spread"), F.lit(1 << 30))
    texts = (coded(train, vocabulary, vocabulary_path) if texts is None else texts).where("filled").select("spread", "ids")
    bare = Attention([], count, counts[1][:0], counts[2][:0], END, cls=model.cls, behind=model.behind[: len(rows_of(count, END))])
    while total and done < 1 << 30:
        now = min(total, first if not done else taken * (GROWTH + 1))
        upto = 1 << 30 if now >= total else int(now / total * (1 << 30))
        own = 1 if not done else max(1, round((now - taken) / part))
        ids = texts.where((place >= done) & (place < upto)).withColumn("part", (F.lit(parts) + F.pmod(F.xxhash64("spread"), F.lit(own))).cast("int"))
        ids = ids.repartitionById(own, F.col("part") - parts).sortWithinPartitions("part", "spread", "ids")
        shared = spark.sparkContext.broadcast((bare, model.flat()))
        learned = ids.mapInArrow(_learned(shared, (now - taken) / own, LATER if done else FIRST, 1 if done else EPOCHS), "chunk int, part int, met binary, weights binary")
        found = sorted(learned.groupBy("chunk").applyInArrow(_averaged, "chunk int, weights binary").collect(), key=lambda r: r["chunk"])
        if found:  # texts may be so few that a range of hashes holds none
            model.put(np.frombuffer(b"".join(r["weights"] for r in found), np.float32).reshape(-1, WIDTH))
        done, taken, parts = upto, now, parts + own
    model.freeze()
    return model


def _profiles(pairs: DataFrame, count: np.ndarray) -> DataFrame:
    """(cell, n) over all pairs: see attention.profile_cells; at most vocabulary x PROFILE rows."""
    near = pa.table({"id": np.arange(SIZE), "near": neighbours(count)})
    of = lambda name: F.broadcast(pairs.sparkSession.createDataFrame(near).toDF(f"{name}_id", f"{name}_near"))
    d = pairs.withColumn("before", F.expr(f"key div {SIZE}")).withColumn("after", F.col("key") % SIZE)
    d = d.join(of("before"), F.col("before") == F.col("before_id")).join(of("after"), F.col("after") == F.col("after_id"))
    cells = F.array(F.col("after") * PROFILE + F.col("before_near"), F.col("before") * PROFILE + NEAR + 1 + F.col("after_near"))
    return d.select(F.explode(cells).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))


def _behind(pairs: DataFrame, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Counts of classes behind the ids with rows, over all pairs: at most vocabulary x CLASSES sums come to the driver."""
    of = F.broadcast(pairs.sparkSession.createDataFrame(pa.table({"id": np.arange(SIZE), "cls": cls})))
    cell = pairs.join(of, F.col("key") % SIZE == F.col("id")).groupBy((F.expr(f"key div {SIZE}") * CLASSES + F.col("cls")).alias("cell")).agg(F.sum("n").alias("n"))
    got = cell.toArrow()
    at = got.column("cell").to_numpy()
    row = np.zeros(SIZE, np.int64)
    met = rows_of(count, END)
    row[met] = np.arange(len(met))
    out = np.zeros((len(met), CLASSES), np.float32)
    out[row[at // CLASSES], at % CLASSES] = got.column("n").to_numpy()
    return out


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words or pairs reach, by steps of an eighth of a doubling: some 500 sums come to the driver."""
    step = F.floor(F.log2("n") * 8)
    held, found = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        found = r["n"]
    return (1 << 62) if found is None else found


def score(docs: DataFrame, in_training: Column, vocabulary: str = VOCABULARY, vocabulary_path: str | None = None, frequent: int = FREQUENT, most_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    Baseline: words are runs without ASCII white space with A-Z lower-cased, then one end; see the module's text. score: log10
    of the probability of the text's subword ids and the end id under the attention model. A null text is empty and consists
    of the end. Without training texts all counts are 0 and the attention model is as it started. Repeated rows are scored each for
    itself; extra columns are not read; an empty table gives no rows. A very long text is scored window by window, its ids at once in memory.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    train = docs.where(in_training)
    texts = stored(coded(docs, vocabulary, vocabulary_path, in_training), "ids")  # every text is encoded once
    found = stored(counts_of(train, texts=texts.where("train")), "counts")
    counts, pairs = found.where(F.col("kind") == WORDS).select(F.col("key").alias("word"), "n"), found.where(F.col("kind") == TWO_IDS).select("key", "n")
    seen = counts.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    total, distinct = seen["tokens"] or 0, seen["words"]
    top = counts.where((F.col("n") >= _threshold(counts, frequent)) | (F.col("word") == int(END_WORD))).toArrow()
    model = fit_attention(train, pairs, most_pairs=most_pairs, texts=texts.where("train"))
    word_table = spark.sparkContext.broadcast(_Frequent(top.column("word").to_numpy(), top.column("n").to_numpy()))
    rows = docs.select("doc_id", *_same_text(), "text").mapInArrow(_based(word_table, total, distinct), "doc_id long, spread long, other long, n_tokens long, n_known long, base double, rest array<long>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "words")
    scored = texts.select("spread", "other", "ids").mapInArrow(_scored(spark.sparkContext.broadcast(model)), "spread long, other long, score double, rare array<long>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    unit = float(np.log10(total + SMOOTHING * (distinct + 1)))
    # the words and pairs that aren't in the tables; for a pair also what stands for its count in the whole corpus (one row an id)
    rest = rows.select("row", F.explode("rest").alias("word")).join(counts, "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + SMOOTHING) - unit).alias("gained"))
    if not model.whole:
        prior = F.broadcast(spark.createDataFrame(pa.table({"id": np.arange(SIZE), "prior": model.prior()})))
        rare = scored.select("row", F.explode("rare").alias("key")).join(pairs, "key").join(prior, F.col("key") % SIZE == F.col("id"))
        rare = rare.groupBy("row").agg(F.sum(F.log10(1 + F.col("n") / F.col("prior"))).alias("paired"))
        scored = scored.join(rare, "row", "left").withColumn("score", F.col("score") + F.coalesce("paired", F.lit(0.0)))
    # rows with the same hashes are equal and have the same score
    of_ids = scored.groupBy("spread", "other").agg(F.max("score").alias("score"))
    known = F.coalesce("more", F.lit(0))
    never = (F.size("rest") - known) * (float(np.log10(SMOOTHING)) - unit)
    return rows.join(rest, "row", "left").join(of_ids, ["spread", "other"]).select(
        "doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gained", F.lit(0.0)) + never).alias("base_score"), "score",
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(10)) == 0, F.lit(False))
    return score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)
