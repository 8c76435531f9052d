"""Value functions of the readers and of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of railway classes and operator types by code.
RAILWAY_CLASSES = {
    "11": "普通鉄道JR", "12": "普通鉄道", "13": "鋼索鉄道", "14": "懸垂式鉄道", "15": "跨座式鉄道", "16": "案内軌条式鉄道", "17": "無軌条鉄道",
    "21": "軌道", "22": "懸垂式モノレール", "23": "跨座式モノレール", "24": "案内軌条式", "25": "浮上式",
}
OPERATOR_TYPES = {"1": "JRの新幹線", "2": "JR在来線", "3": "公営鉄道", "4": "民営鉄道", "5": "第三セクター"}


def sentinel(column: Column, value) -> Column:
    return F.nullif(column, F.lit(value))


def number_or_null(text: Column, kind: str = "int") -> Column:
    """A number of a statistics table: blanks, `*` and `-` stand for none."""
    return F.try_cast(F.trim(text), kind) if hasattr(F, "try_cast") else F.trim(text).try_cast(kind)


def name_of(code: Column, names: dict[str, str]) -> Column:
    """The code's name; an unknown code is an error, null stays null."""
    out = F.raise_error(F.concat(F.lit("unknown code: "), code)).cast("string")
    for k, name in names.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return F.when(code.isNotNull(), out)


def aligned(column: str, keep, *fields: str) -> list[Column]:
    """Lists of fields of the same kept entries."""
    kept = F.filter(column, keep)
    project = lambda field: F.transform(kept, lambda x: x[field])
    return [project(field) for field in fields]


def parse_lods(text: Column) -> Column:
    """Ascending distinct numbers of a comma-joined list; what isn't a number is dropped."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(text, ","), lambda x: x.try_cast("int")))))


def format_lods(lods: Column) -> Column:
    return F.array_join(F.transform(lods, lambda x: x.cast("string")), ",")


def pref_code(file: Column) -> Column:
    code = F.regexp_extract(file, r"E([0-9]{2})[.]zip$", 1)
    return F.when(code != "", code).otherwise(F.raise_error(F.concat(F.lit("no prefecture in "), file)).cast("string"))


def vintage(id_: Column, title: Column, date: Column) -> Column:
    """`ID (date)`: the last word of the title (split at blanks, also ideographic ones) names the release, else the id."""
    last = F.element_at(F.split(F.trim(F.translate(title, "　", " ")), " +"), -1)
    return F.concat(F.coalesce(F.nullif(last, F.lit("")), id_), F.lit(" ("), date, F.lit(")"))


def dem_height(r: Column, g: Column, b: Column) -> Column:
    """Metres of an elevation tile's pixel; 2^23 means no data and counts as 0."""
    x = r * 65536 + g * 256 + b
    return F.when(x == 8388608, 0.0).when(x < 8388608, x.cast("double") / 100).otherwise((x - 16777216).cast("double") / 100)


def terrarium(height: Column) -> Column:
    """struct(r, g, b) of a height in the other tile encoding: (height + 32768) in 1/256 metres."""
    v = F.floor((height + 32768) * 256).cast("long")
    return F.struct(F.shiftright(v, 16).alias("r"), F.shiftright(v, 8).bitwiseAND(F.lit(255)).alias("g"), v.bitwiseAND(F.lit(255)).alias("b"))


def theme_problems(layers: DataFrame, themes: DataFrame) -> DataFrame:
    """(layer, problem): missing, unknown or duplicate layers of themes (layer, theme)."""
    c = themes.groupBy("layer").agg(F.count("*").alias("n")).withColumnRenamed("layer", "listed")
    d = layers.join(c, layers["layer"] == c["listed"], "full")
    problem = F.when(F.col("listed").isNull(), "missing").when(F.col("layer").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return d.select(F.coalesce("layer", "listed").alias("layer"), problem.alias("problem")).where("problem is not null")
