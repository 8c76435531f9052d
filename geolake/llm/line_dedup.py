"""Removal of lines that many documents share, through levelled sorted runs of line hashes.

Lines are keyed by a 128-bit hash. Documents come in batches, the largest ids first. Every batch counts its own keys, meets the
runs written so far in a merge join and is written as one more run: keys that no run holds are new (what an anti-join
leaves) and enter with their largest document, the others only add to the counts. Runs are tables bucketed and sorted by
key, so merging with them shuffles the batch alone; two runs of one level are compacted into one of the next, so a batch
meets at most one run a level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import CAPITALS, SPACE
from .common import shared_dir, spread_join, stored, table

#: Code points that a key needs, and documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a whole table is dealt in.
BATCHES = 4


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, line, key) of all lines with a key of at least so many code points, of rows that have an id; lines count from 0."""
    d = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    # lower() is quicker than translate(), and the same where all is ASCII
    low = F.when(F.octet_length("raw") == F.length("raw"), F.lower("raw")).otherwise(F.translate("raw", CAPITALS, CAPITALS.lower()))
    d = d.where(F.octet_length("raw") >= least_chars).select("doc_id", "text_hash", "line", F.trim(low, F.lit(SPACE)).alias("words"))
    return d.where(F.length("words") >= least_chars).select("doc_id", "text_hash", "line", F.unhex(F.md5(F.col("words").cast("binary"))).alias("key"))


class Runs:
    """Runs of (key, docs, top, seen), bucketed and sorted by key; `seen` parts the keys that an older run holds from the new ones."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.name = spark, shared_dir(spark), f"runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self.tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{len(self.tables)}"
        rows.write.format("parquet").partitionBy("seen").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def _held(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not seen")

    def add(self, counted: DataFrame) -> None:
        """A batch's own keys (key, docs, top), one row a key; its documents must not be in an earlier batch."""
        known = F.lit(False)
        for k, name in enumerate(n for level in self.levels for n in level):
            counted = counted.join(self._held(name).select("key", F.lit(True).alias(f"_in{k}")).hint("merge"), "key", "left")
            known |= F.coalesce(f"_in{k}", F.lit(False))
        self.batches.append(self._write(counted.select("key", "docs", "top", known.alias("seen"))))
        self._put(self.batches[-1], 0)

    def _put(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)

    def compact(self) -> None:
        """Two runs of a level become one of the next. Their keys differ, so that merging is appending bucket by bucket, without a shuffle."""
        for level, names in enumerate(self.levels):
            if len(names) > 1:
                both = self._held(names[0])
                for other in names[1:]:
                    both = both.unionByName(self._held(other))
                self.levels[level] = []
                self._put(self._write(both), level + 1)

    def frequent(self, least_docs: int) -> DataFrame:
        """(key, docs, top) of the keys that so many documents hold: the new ones of all runs and what later batches added."""
        parts = [self._held(n) for level in self.levels for n in level] + [self.spark.table(n).where("seen") for n in self.batches]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")).where(F.col("docs") >= least_docs)

    def drop(self) -> None:
        """Forget the tables; their files stay in the shared folder, as other intermediate tables do."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_hash, lines): which lines each text loses, as sorted numbers.

    A key is found in a document once, however many of its lines or rows have it. Ids are dealt into ranges of about equal numbers of
    rows; which bounds are taken changes no result.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [1 - (k + 1) / batches for k in range(batches - 1)], 10_000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = line_keys(docs, least_chars).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = Runs(spark)
    for b in range(batches):
        own = lines.where(F.col("batch") == b).select("key", "doc_id").distinct()
        runs.add(own.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("top")))
        if b < batches - 1:
            runs.compact()
    frequent = stored(runs.frequent(least_docs), "frequent")
    total = frequent.agg(F.sum("docs")).first()[0] or 0
    found = spread_join(lines.select("doc_id", "text_hash", "line", "key"), frequent, "key", "docs", total).where("doc_id < top")
    gone = stored(found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("lines")), "gone")
    runs.drop()
    return gone


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every row, the text without the lines that it loses.

    Texts are split at \\n. A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of `least_chars` code points that
    `least_docs` documents hold lose their lines in all documents but the one with the largest id. A null text is an empty one with
    one empty line. Rows without an id hold no keys and lose no lines. Rows of one id are one document: they lose lines and keep them
    together, whatever their texts. An empty table gives an empty result. Columns other than doc_id and text aren't read.

    Texts are shuffled once, by id and text, to meet the numbers of their lines; lines of keys with very many rows stay where they are.
    """
    gone = repeated_lines(docs, least_chars, least_docs, batches)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    known = d.where("doc_id is not null").join(gone, ["doc_id", "text_hash"], "left")
    every = known.unionByName(d.where("doc_id is null").withColumn("lines", F.lit(None).cast("array<int>")))
    # a text is split once, and its lines are picked by number: time in proportion to the lines
    none = F.array().cast("array<int>")
    split = F.struct(F.split("text", "\n").alias("all"), F.coalesce("lines", none).alias("gone"))
    kept = F.transform(
        F.array(split),
        lambda s: F.when(F.size(s["gone"]) > 0, F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["all"]) - 1), s["gone"]), lambda i: s["all"][i]), "\n")),
    )[0]
    n = F.regexp_count("text", F.lit("\n")) + 1
    return every.select("doc_id", F.coalesce(kept, "text").alias("text"), n.cast("long").alias("n_lines"), F.size(F.coalesce("lines", none)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
