"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the distinct shingles of `k` words. Its sketch has T coordinates that are filled in rounds: in round i
every shingle is hashed into one bin with the value i + fraction, and a bin keeps its least value; rounds go on until all
bins are filled, and from round T on round i fills bin i - T outright, so every coordinate is filled after at most 2T rounds,
and after one or two for sets larger than T log T. Coordinates of two sets agree with probability J, their number is
concentrated like a sum of independent ones (Dahlgaard, Knudsen, Thorup, 2017). BANDS bands of T / BANDS coordinates give
candidates: a pair with J = 0.8 shares none of them with probability (1 - 0.8^4)^24 < 4e-6. Candidates are confirmed on full sets.

Documents with equal sets form a class and go on as one. The classes of a bucket gather around its hub, those of one hub
form a group, a large group is cut into parts of bounded size. Inside a part components grow by exact comparisons,
starting at the hub, until every two classes are in one component or known to be apart; then the parts' leftovers, what is
not in the hub's component, meet the other parts. No list of pairs is made, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, mix, spread_join, stored, table, text_buffer, words
from .components import components

T = 96
BANDS = 24
PERCENT = 80
#: Members of a group, and shingles of all their sets, that are compared in one place (about: parts are dealt by hash); larger
#: groups go in parts and pairs of parts. A text alone may be longer.
GROUP, GROUP_SHINGLES = 256, 2_000_000
_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FRACTION = np.uint64((1 << 49) - 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of every row, as ascending distinct 64-bit hashes of its k-word shingles; fewer words are one shingle."""
    whole, whole_at = text_buffer(column)
    for lo, hi in blocks(whole_at):
        _, _, h, bound = words(whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo])
        win = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k if len(win) else 0):
            win = mix(win + h[j : len(h) - k + 1 + j])
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if b - a >= k:
                w = np.sort(win[a : b - k + 1])
                yield w[np.concatenate([[True], w[1:] != w[:-1]])]
            else:
                one = np.zeros(min(1, b - a), np.uint64)
                for j in range(a, b):
                    one = mix(one + h[j])
                yield one


def sketch(a: np.ndarray) -> np.ndarray:
    """The T coordinates of a set that isn't empty."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    done = 0
    while done < T:
        rounds = max(1, min(T - done, 4 * T // len(a)))
        g = mix((a[None, :] ^ _SEEDS[done : done + rounds, None]).ravel())
        at = ((g >> np.uint64(32)) * np.uint64(T)) >> np.uint64(32)
        r = np.repeat(np.arange(done, done + rounds, dtype=np.uint64), len(a))
        key = np.sort((at << np.uint64(57)) | (r << np.uint64(49)) | (mix(g) & _FRACTION))
        own = key >> np.uint64(57)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        np.minimum.at(out, own[first].astype(np.int64), key[first])
        done += rounds
        if (out != np.iinfo(np.uint64).max).all():
            return out
    for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[i] = (np.uint64(i) << np.uint64(57)) | (np.uint64(T + i) << np.uint64(49)) | (mix(a ^ _SEEDS[T + i]).min() & _FRACTION)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for c in coordinates.reshape(BANDS, -1).T:
        key = mix(key + c)
    return key.view(np.int64)


def _sketched(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, keys, at = [], [], [], [0]
            for a in shingle_sets(b.column("text"), k):
                n.append(len(a))
                fp.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest())
                # two different sets of which the smaller has n shingles are at most n / (n + 1) alike
                if 100 * len(a) >= percent * (len(a) + 1):
                    keys.append(band_keys(sketch(a)))
                at.append(at[-1] + (BANDS if 100 * len(a) >= percent * (len(a) + 1) else 0))
            bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), bands], ["doc_id", "n", "fp", "bands"])

    return run


def _links_in(ids: list[int], components: list[int | None], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of one group, a spanning forest of them; pairs inside a component are left alone.

    Every pair of different components is decided: all members but those of the largest component are compared with all, by
    counting shared shingles over postings.
    """
    n = len(ids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[int, int] = {}
    for i, c in enumerate(components):
        if c is not None:
            root[find(i)] = find(seen.setdefault(c, i))
    size = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(n), size)
    of = of[np.argsort(code, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(code))])
    own = np.split(code, np.cumsum(size)[:-1])
    done: set[int] = set()
    turn = [0]
    while turn:
        for i in turn:
            done.add(i)
            lo, many = first[own[i]], first[own[i] + 1] - first[own[i]]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(of[at], minlength=n)
            for j in np.flatnonzero(100 * both >= percent * (size[i] + size - both)).tolist():
                if find(i) != find(j):
                    root[find(j)] = find(i)
                    yield ids[i], ids[j]
        roots = [find(i) for i in range(n)]
        largest = max(set(roots), key=lambda r: (roots.count(r), -r))
        turn = [i for i in range(n) if roots[i] != largest and i not in done][:1]


def _compared(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go over from one batch to the next."""
        key, ids, comps, sets = None, [], [], []

        def close() -> pa.RecordBatch:
            found = list(_links_in(ids, comps, sets, percent)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for b in batches:
            keys = zip(b.column("hub").to_pylist(), b.column("part").to_pylist())
            for now, i, c, s in zip(keys, b.column("rep").to_pylist(), b.column("component").to_pylist(), shingle_sets(b.column("text"), k)):
                if now != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, comps, sets = now, [], [], []
                ids.append(i)
                comps.append(c)
                sets.append(s)
        yield close()

    return run


def compare(groups: DataFrame, docs: DataFrame, k: int, percent: int, few: bool = False) -> DataFrame:
    """Links (a, b) inside groups (hub, part, rep, component): groups of a bounded number of rows, their texts side by side.

    The number of tasks is the session's, whatever the groups' bytes: their work is in comparing. few: the groups hold a small
    part of docs; their texts are picked out by the ids alone, which Spark may broadcast below its threshold.
    """
    if few:
        docs = docs.join(groups.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = groups.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select("hub", "part", "rep", "component", "text")
    d = d.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", F.col("rep") != F.col("hub"), "rep")
    return d.mapInArrow(_compared(k, percent), "a long, b long")


def link(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs without ASCII white space with A-Z lower-cased; a text with fewer than k words is one shingle; a null text
    or one without words has the empty set and is linked with nothing. component_id is the smallest doc_id reachable over
    links. Rows with a null doc_id are linked with nothing: component_id null, kept true. Extra columns are not read.
    """
    docs = docs.select("doc_id", "text")
    sketched = stored(docs.mapInArrow(_sketched(k, percent), "doc_id long, n long, fp binary, bands array<long>"), "sketches")
    classes = stored(sketched.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    # one row of a class stands for it
    lead = sketched.where("size(bands) > 0").join(classes, [sketched.doc_id == classes.rep, sketched.fp == classes.fp], "left_semi").dropDuplicates(["doc_id", "fp"])
    entries = stored(lead.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("key")), "bands")
    keys = stored(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    shared = spread_join(entries, keys.withColumn("rows", F.col("c")), "key", "rows", entries.count())
    weight = shared.groupBy("rep").agg(F.sum("c").alias("w"))
    shared = stored(shared.select("key", "rep", "n").join(weight, "rep"), "buckets")
    # a bucket's hub is the member that shares most entries: copies gather around what they were copied from
    hubs = stored(shared.groupBy("key").agg((-F.max(F.struct("w", (-F.col("rep")).alias("r")))["r"]).alias("hub"), F.count("*").alias("rows")), "hubs")
    members = stored(spread_join(shared, hubs, "key", "rows", shared.count()).select("hub", "rep", "n").distinct(), "members")
    counts = stored(members.groupBy("hub").agg(F.count("*").alias("rows"), F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts")), "counts")
    none = F.lit(None).cast("long").alias("component")
    parts = spread_join(members, counts, "hub", "rows", n_members := members.count()).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # the hub stands in every part of its group
    first = parts.withColumn("part", F.explode(F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    links = stored(compare(first.select("hub", "part", "rep", none).hint("merge"), docs, k, percent), "links")
    # groups of several parts: what is still apart from the hub's component meets all other parts
    label = stored(components(links), "labels")
    wide = parts.where("parts > 1").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    wide = stored(wide, "wide")
    if not wide.isEmpty():
        main = stored(wide.where("rep = hub").select("hub", F.col("component").alias("main")).join(counts.select("hub", "rows"), "hub"), "main")
        wide = stored(spread_join(wide, main, "hub", "rows", n_members).withColumn("apart", F.col("component") != F.col("main")), "wide")
        other = wide.where("apart").groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("others"))
        other = stored(other.join(counts.select("hub", "rows"), "hub"), "others")
        wide = spread_join(wide, other, "hub", "rows", n_members).withColumn("o", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("others")).cast("int"))
        to = lambda c, o: F.concat_ws(":", c.cast("string"), o.cast("string"))
        here = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: to(F.col("own"), o))
        there = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: to(c, F.col("o")))
        second = wide.select("hub", "rep", "component", F.explode(F.when(F.col("apart"), F.array_union(here, there)).otherwise(here)).alias("part"))
        more = stored(compare(stored(second, "second"), docs, k, percent, few=True), "more")
        if not more.isEmpty():
            label = components(links.unionByName(more))
    # copies of one text stay where they are, and so do rows without a class
    ends = stored(classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("fp", "rows", F.coalesce("component", "rep").alias("component_id")), "ends")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    out = spread_join(sketched.where(~alone).select("doc_id", "n", "fp"), ends, "fp", "rows", sketched.count()).select("doc_id", "n", "component_id")
    out = out.unionByName(sketched.where(alone).select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Further texts of a repeated id are linked as nodes from here on.
_BEHIND = 1 << 62


def keep(docs: DataFrame, k: int = 2, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that link() keeps, with all their columns: of every group the document with the smallest doc_id.

    Rows with a null doc_id stay, as do those without words. Of rows with one doc_id and one text one stays. Rows with one doc_id and
    different texts are documents of their own, in the order of the texts' hashes. Only the rows of such ids are grouped. An empty
    table stays empty.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(text).alias("least"), F.max(text).alias("most")).where("rows > 1"), "repeated")
    if ids.isEmpty():
        kept = stored(link(docs, k, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")), "kept").hint("merge")  # most ids are kept: as many as there are documents
        return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").unionByName(docs.where("doc_id is null"))
    # a struct holds the row, so that names cannot clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", text.alias("hash"))
    once = whole.join(ids.select("doc_id"), "doc_id", "left_anti").select("row", F.col("doc_id").alias("node"))
    node = F.when(F.col("hash") == F.col("least"), F.col("doc_id")).otherwise(F.lit(_BEHIND) + F.pmod(F.xxhash64("doc_id", "hash"), F.lit(_BEHIND)))
    more = whole.join(ids, "doc_id").select("row", node.alias("node"), F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy(F.xxhash64("row"))).alias("copy"))
    nodes = stored(once.unionByName(more.where("copy = 1").drop("copy")), "nodes")
    found = link(nodes.select(F.col("node").alias("doc_id"), "row.text"), k, percent).where("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id")
    first = found.join(nodes.select("node", "row.doc_id"), "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "node"))["node"].alias("node"))
    return nodes.join(stored(first.select("node"), "kept"), "node", "left_semi").unionByName(nodes.where("node is null")).select("row.*")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
