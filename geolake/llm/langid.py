"""Language identification by prediction with partial matching (PPM).

For every language a context tree over bytes holds how often each byte followed each context of up to ORDER bytes in training
texts. The statistics are frozen: a byte costs -log2 of its share in the longest context that was seen (escape method C: a
context with n visits and q different followers gives a byte with count c the share c / (n + q) and the escape q / (n + q));
where the byte didn't follow, the escape is paid and the next shorter context is asked, at last all bytes alike. A text's code
length is the sum over all its bytes, exactly; the language with the shortest code is predicted.

The trees are laid out as arrays: symbols are the bytes met in training and one for all others, contexts of ORDER symbols that
were met have a row of costs, one for each symbol and language, all others share the row of their longest shorter context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_of_id, table, text_buffer

ORDER = 3
#: Documents of one language that are learned from, at most (about: the sample is a range of hash values).
SAMPLE = 2000
#: Bytes of the trees' tables that are broadcast, at most; more is an error.
MODEL_BYTES = 512 << 20
START = 10  # a line feed stands before every text


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): how often each ORDER + 1 bytes, as a base-256 number, end in a text of the language."""
    for b in batches:
        langs = b.column("lang").to_pylist()
        buf, at = text_buffer(b.column("text"))
        out: dict[str, list[np.ndarray]] = {}
        for i, lang in enumerate(langs):
            t = np.concatenate([np.full(ORDER, START, np.uint8), buf[at[i] : at[i + 1]]]).astype(np.int64)
            gram = t[ORDER:].copy()
            for k in range(1, ORDER + 1):
                gram += t[ORDER - k : len(t) - k] << (8 * k)
            out.setdefault(lang, []).append(gram)
        cols: tuple[list, list, list] = ([], [], [])
        for lang, grams in out.items():
            g, n = np.unique(np.concatenate(grams), return_counts=True)
            cols[0].extend([lang] * len(g))
            cols[1].append(g)
            cols[2].append(n)
        g = np.concatenate(cols[1]) if cols[1] else np.zeros(0, np.int64)
        n = np.concatenate(cols[2]) if cols[2] else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])


class Model:
    """Frozen context trees of all languages as arrays; see the module's text."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        met = sorted({START} | {int(x) for g, _ in counts.values() for x in np.unique(g & 255)})
        self.size = size = len(met) + 1  # the last symbol stands for all other bytes
        self.symbol = np.full(256, size - 1, np.int32)
        self.symbol[met] = np.arange(size - 1)
        grams = {}
        for lang, (g, n) in counts.items():
            s = self.symbol[g & 255].astype(np.int64)
            for k in range(1, ORDER + 1):
                s += self.symbol[(g >> (8 * k)) & 255].astype(np.int64) * size**k
            grams[lang] = (s, n)
        # rows: every context of ORDER symbols that any language met, then all of ORDER - 1 symbols
        contexts = np.unique(np.concatenate([s // size for s, _ in grams.values()])) if grams else np.zeros(0, np.int64)
        short = size ** (ORDER - 1)
        self.row = (np.arange(size**ORDER, dtype=np.int64) % short + len(contexts)).astype(np.int32)
        self.row[contexts] = np.arange(len(contexts), dtype=np.int32)
        self.costs = np.zeros(((len(contexts) + short) * size, len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            self.costs[:, k] = self._costs(*grams[lang], contexts)

    def _costs(self, gram: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        size = self.size
        cost = np.full((1, size), np.log2(257.0))  # nothing is known: all bytes and the end alike
        for order in range(ORDER):  # dense tables of the short contexts
            c = np.zeros(size ** (order + 1))
            np.add.at(c, gram % size ** (order + 1), n)
            cost = self._refined(c.reshape(-1, size), np.tile(cost, (size if order else 1, 1)))
        long = np.zeros((len(contexts), size))
        np.add.at(long, (np.searchsorted(contexts, gram // size), gram % size), n)
        return np.concatenate([self._refined(long, cost[contexts % size ** (ORDER - 1)]), cost]).ravel()

    @staticmethod
    def _refined(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Costs in contexts with these counts, given the costs in the contexts one symbol shorter."""
        visits, followers = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log2(visits + followers) - np.log2(count)
            escape = np.log2(visits + followers) - np.log2(followers)
        return np.where(visits == 0, shorter, np.where(count > 0, seen, escape + shorter))

    def code_lengths(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of every row under every language."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        size = self.size
        for lo, hi in blocks(at, 1 << 20):
            for first in range(int(at[lo]), int(at[hi]), 1 << 20):  # one long row goes in parts
                last = min(first + (1 << 20), int(at[hi]))
                before = min(ORDER, first)
                s = self.symbol[buf[first - before : last]]
                if before < ORDER:
                    s = np.concatenate([np.full(ORDER - before, self.symbol[START], np.int32), s])
                starts = at[lo : hi + 1]
                starts = starts[(starts >= first) & (starts < last)] - first
                context = np.zeros(last - first, np.int32)
                for k in range(ORDER, 0, -1):
                    part = s[ORDER - k : len(s) - k].copy()
                    for j in range(k):  # the row before is no context
                        near = starts + j
                        part[near[near < len(part)]] = self.symbol[START]
                    context = context * size + part
                cost = self.costs[self.row[context].astype(np.int64) * size + s[ORDER:]]
                edges = np.clip(at[lo : hi + 1], first, last) - first
                rows = np.flatnonzero(np.diff(edges)) + lo
                if len(rows):
                    out[rows] += np.add.reduceat(cost, edges[rows - lo], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, learned_from: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on documents with a text, a language and, if given, the condition. Of a language with more than `sample` of them
    a range of hash values with about as many is used; counts of byte grams of that sample come to the driver."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    d = d.where(learned_from) if learned_from is not None else d
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = F.lit(0)
    for lang, n in sizes.items():
        most = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / n) * (1 << 30)))).otherwise(most)
    grams = d.where(spread < most).select("lang", "text").mapInArrow(count_contexts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(grams.column("lang").to_pylist(), object)
    g, n = grams.column("gram").to_numpy(), grams.column("n").to_numpy()
    return Model({x: (g[lang == x], n[lang == x]) for x in sizes if (lang == x).any()})


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            text = b.column("text")
            buf, at = text_buffer(text)
            if m.langs:
                bits = m.code_lengths(buf, at)
                best = bits.argmin(1)
                behind = bits - bits[np.arange(len(best)), best][:, None]
                score = 1 / np.exp2(-np.minimum(behind, 1000)).sum(1)
                pred = np.array([*m.langs, None], object)[best]
            else:
                score, pred = np.zeros(len(text)), np.full(len(text), None, object)
            # a letter anywhere: most texts show it early
            for i, t in enumerate(text):
                t = t.as_py()
                if t is None or not (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))) or pred[i] is None:
                    pred[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(pred, pa.string()), pa.array(score)], [*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """lang_pred and score of every row, beside doc_id or, with `carry`, a struct of that name with all columns of docs.

    score: the share of the predicted language if all were equally likely before. A null text or one without a letter is `und`
    with score 0, as is every text if nothing was learned. Of languages with equally short codes the first by name is taken. Rows
    are judged each for itself, so repeated rows give repeated results; very long texts are coded whole, in parts. An empty table gives no rows. The model's arrays are broadcast; their size follows from the
    bounded sample and the byte alphabet, not from docs.
    """
    if model.costs.nbytes > MODEL_BYTES:
        raise ValueError(f"the trees of {len(model.langs)} languages take {model.costs.nbytes} bytes: learn from fewer languages or documents")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry) if carry else F.col("doc_id")
    d = docs.select(first, "text")
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(_predict(shared), f"{d.columns[0]} {kind}, lang_pred string, score double")


def keep(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, in a language that was learned from their own labels; `und` and undecided ones go.

    A null text is `und`; a null language teaches nothing but is no reason to go. Repeated rows stay repeated.
    """
    return identify(docs, train(docs), "row").where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda c="doc_id": F.pmod(crc_of_id(c), F.lit(4))
    found = identify(docs.select("doc_id", "text"), train(docs, F.coalesce(fold() != 2, F.lit(True))))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
