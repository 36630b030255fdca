"""Texts cut into runs of one script, with the style each run is set in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekha.functions.bangla import encode_lines, is_bangla, let
from lekha.functions.script import BANGLA, DANDAS

#: The name of the font that Bengali runs get where none is given.
DEFAULT_FONT = "default-bangla"
STYLE = "struct<font:string,font_size:double,font_weight:string,color:string>"
RUNS = f"[{BANGLA}{DANDAS}]+ *|[^{BANGLA}{DANDAS}]+"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def style(font=None, font_size=None, font_weight=None, color=None) -> Column:
    """A style; each part a column or a value, null where not given."""
    parts = (("font", font, "string"), ("font_size", font_size, "double"), ("font_weight", font_weight, "string"), ("color", color, "string"))
    return F.struct(*[_col(v).cast(t).alias(n) for n, v, t in parts])


def general_style(given: Column | None, font=None, font_size=16.0, font_weight="normal", color="black") -> Column:
    """Of runs in other scripts: a given style replaces all arguments."""
    own = style(font, font_size, font_weight, color)
    return own if given is None else F.coalesce(given, own)


def bangla_style(given: Column | None, font=None, font_size=16.0, font_weight="normal", color="black") -> Column:
    """Of Bengali runs: a given style replaces the arguments, but for a font that it lacks."""
    name = F.coalesce(_col(font).cast("string"), F.lit(DEFAULT_FONT))
    own = style(name, font_size, font_weight, color)
    if given is None:
        return own
    return F.when(given.isNotNull(), given.withField("font", F.coalesce(given["font"], name))).otherwise(own)


def bold(given: Column | None) -> Column | None:
    """The style with bold weight; a style that is not given stays so."""
    return None if given is None else F.when(given.isNotNull(), given.withField("font_weight", F.lit("bold")))


def runs(text: Column) -> Column:
    """array<string>: runs of one script that together are the text.

    A Bengali run takes the plain spaces after it; dandas belong to it, joiners do not. No runs for an
    empty text, null for null.
    """
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def spans(text: Column, general: Column | None = None, bangla: Column | None = None) -> Column:
    """array<struct<is_bangla, raw, text, style>> of the runs, Bengali ones fixed.

    Bengali runs hold no line feed, and no rule looks across one: so all runs of a text are encoded at
    once, as lines of one string.
    """
    general, bangla = general_style(None) if general is None else general, bangla_style(None) if bangla is None else bangla

    def kind(run: Column) -> Column:
        """A run and its script, told by how its string compares: all of a run's characters but spaces are of one kind."""
        letter, danda = (run >= "\u0980") & (run < "\u0a00"), (run >= "\u0964") & (run < "\u0966")
        return F.struct((letter | danda).alias("own"), run.alias("raw"), (letter | (danda & is_bangla(run))).alias("fixed"))

    def of(kinds: Column) -> Column:
        lines = F.array_join(F.transform(kinds, lambda k: F.when(k["fixed"], k["raw"]).otherwise(F.lit(""))), "\n")

        def one(k: Column, line: Column) -> Column:
            return F.struct(k["own"].alias("is_bangla"), k["raw"].alias("raw"), F.when(k["fixed"], line).otherwise(k["raw"]).alias("text"), F.when(k["own"], bangla).otherwise(general).alias("style"))

        return let(F.split(encode_lines(lines), "\n", -1), lambda fixed: F.transform(kinds, lambda k, i: one(k, fixed[i])))

    return let(F.transform(runs(text), kind), of)
