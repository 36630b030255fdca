"""What characters a font file covers, read from its bytes by SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(content: Column, at: Column, size: int) -> Column:
    """The unsigned big-endian number of `size` bytes at offset `at`."""
    return F.conv(F.hex(F.substr(content, at.cast("int") + 1, F.lit(size))), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _each(n: Column, body) -> Column:
    """body(0), ..., body(n - 1)."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), body)


def _segments(content: Column, at: Column) -> Column:
    """Ranges of a character map's subtable at that offset: formats 4 and 12, others have none."""
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    four = _let(_number(content, at + 6, 2), lambda n: _each(F.floor(n / 2), lambda i: pair(_number(content, at + 16 + n + 2 * i, 2), _number(content, at + 14 + 2 * i, 2))))
    twelve = _each(_number(content, at + 12, 4), lambda i: pair(_number(content, at + 16 + 12 * i, 4), _number(content, at + 20 + 12 * i, 4)))
    kind = _number(content, at, 2)
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.when(kind == 4, F.filter(four, lambda x: x["first"] < 0xFFFF)).when(kind == 12, twelve).otherwise(none)


def covered(assets: DataFrame) -> DataFrame:
    """assets (path, content) -> (path, first, last): ranges of code points in the Unicode character maps of TrueType and OpenType files.

    The directory names the table of character maps, its subtables for Unicode (platform 0, or 3 with
    encodings 1 and 10) give segments; a range may be there twice. Other files, and fonts without such a map,
    give no rows.
    """
    content = F.col("content")
    fonts = assets.where(F.hex(F.substring("content", 1, 4)).isin("00010000", "4F54544F", "74727565")).withColumn("n", _number(content, F.lit(4), 2))
    entries = _each(F.col("n"), lambda i: F.struct(F.hex(F.substr(content, (13 + 16 * i).cast("int"), F.lit(4))).alias("tag"), _number(content, 20 + 16 * i, 4).alias("at")))
    maps = fonts.select("path", "content", F.get(F.filter(entries, lambda e: e["tag"] == "636D6170"), 0)["at"].alias("base")).where("base is not null")
    tables = _each(_number(content, F.col("base") + 2, 2), lambda i: F.struct(*[_number(content, F.col("base") + 4 + 8 * i + k, n).alias(name) for name, k, n in (("platform", 0, 2), ("encoding", 2, 2), ("at", 4, 4))]))
    known = lambda t: (t["platform"] == 0) | (t["platform"] == 3) & t["encoding"].isin(1, 10)
    subtables = maps.select("path", "content", "base", F.explode(F.filter(tables, known)).alias("t"))
    found = subtables.select("path", F.explode(_segments(content, F.col("base") + F.col("t.at"))).alias("r"))
    return found.select("path", "r.first", "r.last").where("first <= last").distinct()


def missing_characters(texts: DataFrame, text: Column, ranges: DataFrame) -> DataFrame:
    """(code, n): characters of all texts that none of the fonts covers, and how often they stand there.

    Texts are counted by character before anything moves, so what meets the fonts is at most all of
    Unicode; ranges are spread to code points, so the join is by equality. White space needs no glyph.
    """
    codes = texts.select(F.explode(F.filter(F.split(text, ""), lambda c: ~c.rlike(r"^\s*$"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    codes = codes.select(F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long").alias("code"), "n")
    points = ranges.select(F.explode(F.sequence("first", "last")).alias("code"))
    return codes.join(points, "code", "left_anti")
