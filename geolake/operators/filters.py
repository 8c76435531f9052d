"""Attribute filters and search conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def value_in(column: Column, values: list | None) -> Column:
    """null list: no filter; empty list: nothing passes."""
    return F.lit(True) if values is None else column.isin(values) if values else F.lit(False)


def matches(expression: Column, keyword: str) -> Column:
    """All words of the keyword (split at white space, also the ideographic one) occur, in any case; % and _ are wildcards."""
    tokens = keyword.replace("　", " ").split()
    return reduce(lambda a, b: a & b, [expression.ilike("%" + t.replace("\\", "\\\\") + "%") for t in tokens], F.lit(True))


def at_least(df: DataFrame, column: str, least: float) -> Column:
    """column >= least where the table has the column and least is positive; nulls don't pass then."""
    return F.col(column) >= least if least > 0 and column in df.columns else F.lit(True)


def level(df: DataFrame, lod: int) -> Column:
    return F.col("lod") == lod if "lod" in df.columns else F.lit(True)


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by the order, which must end in a unique key so that ties are settled: TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def export(df: DataFrame, path: str, most: int, form: str = "parquet") -> int:
    """Write what was chosen, in one pass, and return its rows. More than `most` rows is an error, and what was written is removed; no more than one row beyond is written."""
    seen = Observation()
    spark = df.sparkSession
    df.limit(most + 1).observe(seen, F.count(F.lit(1)).alias("n")).write.format(form).save(path)
    n = seen.get["n"]
    if n > most:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        raise ValueError(f"more than {most} rows")
    return n


def is_municipality(subtype: Column, name: Column) -> Column:
    """A locality whose name has one of the four kinds of municipality in it."""
    return (subtype == "locality") & name.rlike("^.*(市|町|村|区)$")


def tier_id(value: Column, name: Column | None, rules: list[tuple[str, list[str] | None]], named_first: bool) -> Column:
    """The tier's id: named rows belong to the first tier if named_first, otherwise the first tier that lists the value; the last
    tier takes the rest."""
    out = F.lit(rules[-1][0])
    for tier, values in reversed(rules[:-1]):
        out = F.when(value.isin(values), F.lit(tier)).otherwise(out)
    if named_first:
        out = F.when(name.isNotNull() & (name != ""), F.lit(rules[0][0])).otherwise(out)
    return out


def tier_rank(value: Column, name: Column | None, rules: list[tuple[str, list[str] | None]], named_first: bool) -> Column:
    """0 for the first tier, and so on."""
    own = tier_id(value, name, rules, named_first)
    return reduce(lambda out, k: F.when(own == rules[k][0], F.lit(k)).otherwise(out), range(len(rules)), F.lit(None).cast("int"))


def check_rules(rules: list[tuple[str, list[str] | None]], columns: list[str], column: str, named_first: bool) -> None:
    """A value twice, values on the last tier, a missing column, or named_first without a name is an error."""
    values = [v for _, vs in rules for v in vs or []]
    if len(values) != len(set(values)):
        raise ValueError("a value belongs to two tiers")
    if rules[-1][1]:
        raise ValueError("the last tier takes the rest and lists nothing")
    if column not in columns or (named_first and "name" not in columns):
        raise ValueError("a column of the rules is missing")
