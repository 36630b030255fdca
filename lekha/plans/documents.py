"""Documents of blocks of any kinds, laid out in one pass.

A document is an array of BLOCK. Every kind comes down to cells, and every cell to parts with a style each, so
a document is exploded twice and its texts are cut into runs by one expression, whatever its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions.spans import DEFAULT_FONT, spans
from lekha.plans import layout

PART = "struct<text:string,font_size:double,font_weight:string,color:string,bangla_font:string>"
BLOCK = f"struct<kind:string,text:string,parts:array<{PART}>,items:array<string>,cells:array<array<string>>,font_size:double>"
#: The columns of a document's span table.
SPANS = ["doc_id", "block_ord", *(c for c in layout.SPANS if c != "block_id")]
_CELL = f"struct<row:int,col:int,align:string,marker:boolean,parts:array<{PART}>>"
_ONE = {"text": layout.TEXT, "auto_text": layout.TEXT, "header": layout.HEADER, "paragraph": layout.PARAGRAPH}


def block(kind: str, **fields: Column) -> Column:
    """One block: text of text, auto_text, header and paragraph; parts of rich_text; items of bullet_list; cells of table; a space has nothing."""
    given = {"kind": F.lit(kind)} | fields
    types = {"kind": "string", "text": "string", "parts": f"array<{PART}>", "items": "array<string>", "cells": "array<array<string>>", "font_size": "double"}
    if unknown := set(given) - set(types):
        raise ValueError(f"no such fields of a block: {sorted(unknown)}")
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def _part(text: Column, size: Column, weight: Column) -> Column:
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), size.cast("double").alias("font_size"), weight.alias("font_weight"), F.lit("black").alias("color"), F.lit(None).cast("string").alias("bangla_font"))


def _cell(row: Column, col: Column, align: Column, parts: Column, marker: bool = False) -> Column:
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), align.alias("align"), F.lit(marker).alias("marker"), parts.alias("parts")).cast(_CELL)


def _cells(b: Column) -> Column:
    """A block's cells; unknown kinds, spaces and null blocks have none."""
    zero, start = F.lit(0), F.lit("start")
    out = F.when(b["kind"] == "rich_text", F.array(_cell(zero, zero, start, F.filter(F.coalesce(b["parts"], F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()))))
    for kind, look in _ONE.items():
        out = out.when(b["kind"] == kind, F.array(_cell(zero, zero, start, F.array(_part(b["text"], F.coalesce(b["font_size"], F.lit(look.font_size)), F.lit(look.font_weight))))))
    size, normal = F.coalesce(b["font_size"], F.lit(14.0)), F.lit("normal")
    marker = F.lit(layout.BULLETS.extra["bullet"] + "  ")
    items = F.transform(b["items"], lambda x, i: F.array(_cell(i, zero, start, F.array(_part(marker, size, normal)), True), _cell(i, F.lit(1), start, F.array(_part(x, size, normal)))))
    head = lambda i: i == 0
    table = F.transform(b["cells"], lambda row, i: F.transform(row, lambda x, j: _cell(i, j, F.when(head(i), layout.TABLE.extra["header_align"]).otherwise(start), F.array(_part(x, size, F.when(head(i), "bold").otherwise(normal))))))
    return out.when(b["kind"] == "bullet_list", F.flatten(items)).when(b["kind"] == "table", F.flatten(F.filter(table, lambda row: row.isNotNull()))).otherwise(F.array().cast(f"array<{_CELL}>"))


def _laid(cell: Column) -> Column:
    """The spans of a cell's parts, one after the other."""

    def of(p: Column) -> Column:
        look = layout.Look(F.coalesce(p["font_size"], F.lit(16.0)), F.coalesce(p["font_weight"], F.lit("normal")), F.coalesce(p["color"], F.lit("black")), bangla_font=F.coalesce(p["bangla_font"], F.lit(DEFAULT_FONT)))
        text = F.coalesce(p["text"], F.lit(""))
        general, bangla = look.styles()
        whole = F.array(F.struct(F.lit(False).alias("is_bangla"), text.alias("raw"), text.alias("text"), general.alias("style")))
        return F.when(cell["marker"], whole).otherwise(spans(text, general, bangla))

    return F.flatten(F.transform(cell["parts"], of))


def document_blocks(df: DataFrame, doc_id: Column, blocks: Column) -> DataFrame:
    """A row of SPANS for each span; blocks: array of BLOCK, numbered from 0 as they stand.

    Headers are at level 0, paragraphs, tables and their cells are in the boxes of lekha.plans.layout. Rows of a
    list and of a table, cells and spans are numbered inside their block. Null blocks, null lists and empty
    texts have no spans, nor have null rows of a table; a null cell or item is empty. No join, no shuffle.
    """
    rows = df.select(doc_id.alias("doc_id"), F.posexplode(blocks).alias("block_ord", "b"))
    cells = rows.select("doc_id", "block_ord", F.col("b.kind").alias("block_kind"), F.explode(_cells(F.col("b"))).alias("c"))
    at = cells.select("doc_id", "block_ord", "block_kind", "c", F.posexplode(_laid(F.col("c"))).alias("span_ord", "x"))
    kind, head = F.col("block_kind"), F.col("c.row") == 0
    table, extra = kind == "table", layout.TABLE.extra
    box = {
        "level": F.when(kind == "header", 0), "padding": F.when(table, extra["padding"]), "padding_bottom": F.when(kind == "paragraph", 12), "fill": F.when(table & head, extra["header_color"]),
        "border": F.when(table, extra["border_color"]), "cell_align": F.when(table & ~head, extra["cell_align"]), "vertical_align": F.when(table, "middle"),
    }
    return at.select(
        "doc_id", "block_ord", "block_kind", F.col("c.row").alias("row_ord"), F.col("c.col").alias("col_ord"), "span_ord", "x.is_bangla", "x.raw", "x.text", "x.style.font", "x.style.font_size", "x.style.font_weight",
        "x.style.color", F.col("c.align").alias("text_align"), *[box.get(k, F.lit(None)).cast(t).alias(k) for k, t in layout.BOX.items()],
    )
