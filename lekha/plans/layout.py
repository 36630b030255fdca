"""Documents of blocks laid out as one flat table of styled spans.

Every builder turns rows into rows of SPANS, numbered inside their block: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions.spans import bangla_style, bold, general_style, spans

#: What a span table says of the box around a span, null where the kind of block has no such thing.
BOX = {"level": "int", "padding": "double", "padding_left": "double", "padding_top": "double", "padding_right": "double", "padding_bottom": "double", "fill": "string", "border": "string", "cell_align": "string", "vertical_align": "string", "column_width": "double"}
#: The columns of a span table.
SPANS = [*"block_id block_kind row_ord col_ord span_ord is_bangla raw text font font_size font_weight color text_align".split(), *BOX]


@dataclass(frozen=True)
class Look:
    """How a kind of block is set; each part a value or a column. `style` and `bangla_style` are struct columns or None.

    `extra` holds what only some kinds have: of BOX the values that hold for the whole block, the bullet of
    a list, and of a table the padding (one number, or a dict of left, top, right, bottom, vertical and
    horizontal), the heading's align and color, the border's color, the cells' align and the
    columns' widths (a dict or a map column from column number to width).
    """

    font_size: float | Column = 16.0
    font_weight: str | Column = "normal"
    color: str | Column = "black"
    text_align: str | Column = "start"
    font: str | Column | None = None
    bangla_font: str | Column | None = None
    style: Column | None = None
    bangla_style: Column | None = None
    extra: dict = field(default_factory=dict)

    def styles(self, heading: bool = False) -> tuple[Column, Column]:
        weight = "bold" if heading else self.font_weight
        given = (bold(self.style), bold(self.bangla_style)) if heading else (self.style, self.bangla_style)
        return (
            general_style(given[0], self.font, self.font_size, weight, self.color),
            bangla_style(given[1], self.bangla_font, self.font_size, weight, self.color),
        )


TEXT = Look()
#: Outline level 0.
HEADER = Look(font_size=24.0, font_weight="bold", extra={"level": 0})
PARAGRAPH = Look(font_size=14.0, extra={"padding_bottom": 12})
BULLETS = Look(font_size=14.0, extra={"bullet": "• "})
TABLE = Look(font_size=14.0, text_align="start", extra={"header_align": "center", "header_color": "grey300", "border_color": "grey", "cell_align": "centerLeft", "padding": 6})


def _box(given: dict) -> Column:
    if isinstance(given.get("padding"), dict):  # by side, or vertical and horizontal
        sides = given["padding"]
        both = {"left": "horizontal", "right": "horizontal", "top": "vertical", "bottom": "vertical"}
        given = {k: v for k, v in given.items() if k != "padding"} | {f"padding_{k}": sides.get(k, sides.get(b, 0)) for k, b in both.items()}
    values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items() if k in BOX}
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in BOX.items()]).alias("box")


def _flat(rows: DataFrame, at: list, s: Column, kind: str) -> DataFrame:
    """rows as span rows; at: their block_id, row_ord, col_ord, align and box, s: array of spans.

    The spans are made inside the explode: of a column made before it, Spark first asks whether it is null or
    empty, which makes it twice more.
    """
    at = rows.select(*at, F.posexplode(s).alias("span_ord", "x"))
    return at.select(
        "block_id", F.lit(kind).alias("block_kind"), "row_ord", "col_ord", "span_ord", "x.is_bangla", "x.raw", "x.text",
        "x.style.font", "x.style.font_size", "x.style.font_weight", "x.style.color", F.col("align").alias("text_align"), *[f"box.{k}" for k in BOX],
    )


def _align(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).alias("align")


def _zero(name: str) -> Column:
    return F.lit(0).alias(name)


def _one_block(df: DataFrame, block_id: Column, s: Column, align, extra: dict, kind: str) -> DataFrame:
    return _flat(df, [block_id.alias("block_id"), _zero("row_ord"), _zero("col_ord"), _align(align), _box(extra)], s, kind)


def text_blocks(df: DataFrame, block_id: Column, text: Column, look: Look = TEXT, kind: str = "text") -> DataFrame:
    """One block a row. Kinds with looks of their own: header, paragraph. A text block has no general font."""
    if kind == "text":
        look = replace(look, font=None)
    return _one_block(df, block_id, spans(text, *look.styles()), look.text_align, look.extra, kind)


def auto_text_blocks(df: DataFrame, block_id: Column, text: Column, look: Look = TEXT) -> DataFrame:
    """As text blocks, in a general font if one is given."""
    return text_blocks(df, block_id, text, look, "auto_text")


def header_blocks(df: DataFrame, block_id: Column, text: Column, look: Look = HEADER) -> DataFrame:
    return text_blocks(df, block_id, text, look, "header")


def paragraph_blocks(df: DataFrame, block_id: Column, text: Column, look: Look = PARAGRAPH) -> DataFrame:
    return text_blocks(df, block_id, text, look, "paragraph")


def text_span(text: Column, font_size: float | Column = 16.0, font_weight: str | Column = "normal", color: str | Column = "black", bangla_font: str | Column | None = None) -> Column:
    """The record of one part of a rich text."""
    values = (("font_size", font_size, "double"), ("font_weight", font_weight, "string"), ("color", color, "string"), ("bangla_font", bangla_font, "string"))
    return F.struct(text.cast("string").alias("text"), *[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, v, t in values])


def rich_text_item(text: Column, font_size: float | Column = 14.0, font_weight: str | Column | None = None, color: str | Column = "black", bangla_font: str | Column | None = None) -> Column:
    """The same in the smaller default size of list-like parts."""
    return text_span(text, font_size, font_weight, color, bangla_font)


def rich_text_blocks(df: DataFrame, block_id: Column, parts: Column, text_align: str = "start") -> DataFrame:
    """parts: array<struct<text, font_size, font_weight, color, bangla_font>>, null for the default; spans stay in the parts' order.

    A part that is null, or whose text is, has no spans; the others stay.
    """

    def of(p: Column) -> Column:
        look = Look(F.coalesce(p["font_size"], F.lit(16.0)), F.coalesce(p["font_weight"], F.lit("normal")), F.coalesce(p["color"], F.lit("black")), bangla_font=p["bangla_font"])
        return spans(F.coalesce(p["text"], F.lit("")), *look.styles())

    return _one_block(df, block_id, F.flatten(F.transform(parts, of)), text_align, {}, "rich_text")


def bullet_blocks(df: DataFrame, block_id: Column, items: Column, look: Look = BULLETS) -> DataFrame:
    """items: array<string>. Column 0 holds the marker, never cut by script, column 1 the item; an empty list has no rows."""
    general, bangla = look.styles()
    marker = look.extra.get("bullet", "• ") + "  "
    own = F.array(F.struct(F.lit(False).alias("is_bangla"), F.lit(marker).alias("raw"), F.lit(marker).alias("text"), general_style(look.style, None, look.font_size, look.font_weight, look.color).alias("style")))
    rows = df.select(block_id.alias("block_id"), F.posexplode(items).alias("row_ord", "item"))
    cells = rows.select("block_id", "row_ord", _align(look.text_align), _box(look.extra), F.posexplode(F.array(own, spans(F.col("item"), general, bangla))).alias("col_ord", "s"))
    return _flat(cells, ["block_id", "row_ord", "col_ord", "align", "box"], F.col("s"), "bullet_list")


def table_blocks(df: DataFrame, block_id: Column, data: Column, look: Look = TABLE) -> DataFrame:
    """data: array<array<string>>, the first row the heading, set bold and aligned on its own. Text is black whatever the look's color; an empty table has no rows.

    The heading is filled, the cells below are aligned in their boxes; columns without a width have none.
    """
    look = replace(look, color="black")
    rows = df.select(block_id.alias("block_id"), F.posexplode(data).alias("row_ord", "cells"), *([look.extra["widths"].alias("widths")] if isinstance(look.extra.get("widths"), Column) else []))
    cells = rows.select("block_id", "row_ord", *(["widths"] if "widths" in rows.columns else []), F.posexplode("cells").alias("col_ord", "cell"))
    head = F.col("row_ord") == 0
    plain, heading = look.styles(), look.styles(heading=True)
    s = spans(F.col("cell"), *[F.when(head, h).otherwise(p) for h, p in zip(heading, plain)])
    align = F.when(head, F.lit(look.extra.get("header_align", "center"))).otherwise(_align(look.text_align))
    box = {k: v for k, v in look.extra.items() if k in BOX} | {
        "fill": F.when(head, F.lit(look.extra.get("header_color", "grey300"))), "border": look.extra.get("border_color", "grey"), "vertical_align": look.extra.get("vertical_align", "middle"),
        "cell_align": F.when(~head, F.lit(look.extra.get("cell_align", "centerLeft"))), "column_width": _width(look.extra.get("widths")),
    }
    return _flat(cells, ["block_id", "row_ord", "col_ord", align.alias("align"), _box(box)], s, "table")


def _width(widths) -> Column:
    if widths is None or widths == {} if not isinstance(widths, Column) else False:
        return F.lit(None)
    given = F.col("widths") if isinstance(widths, Column) else F.create_map(*[F.lit(x) for k, v in widths.items() for x in (int(k), float(v))])
    return F.try_element_at(given, F.col("col_ord"))
