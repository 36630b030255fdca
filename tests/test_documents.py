"""Mixed documents, column widths, places of errors, UTF-16, fonts."""

import struct

import pytest
from pyspark.sql import functions as F

from lekha.functions import bangla as B
from lekha.plans import documents, layout
from lekha.plans.widths import WIDTH, column_widths, width
from lekha.sources.fonts import covered, missing_characters

TABLE = [["পণ্য", "মোট"], ["কফি", "$20", "চা"], [None, ""], None, []]


def test_demo_document(spark):
    """One document of all kinds, null and unknown blocks among them."""
    part = lambda t, size=None, weight=None, color=None: (t, size, weight, color, None)
    blocks = [
        ("text", "বাংলা", None, None, None, 20.0), None, ("rich_text", None, [part("বাংলা বোল্ড ", 20.0, "bold", "red"), None, part("x", color="blue"), part(None)], None, None, None), ("header", "শিরোনাম", None, None, None, None),
        ("paragraph", "অনুচ্ছেদ a", None, None, None, None), ("space", "never", None, None, None, None), ("bullet_list", None, None, ["প্রথম", None], None, None), ("table", None, None, None, TABLE, 16.0), ("video", "x", None, None, None, None),
        ("text", None, None, None, None, None), ("rich_text", None, None, None, None, None), ("bullet_list", None, None, None, None, None), ("table", None, None, None, [], None),
    ]
    df = spark.createDataFrame([(7, blocks), (8, None), (9, [])], f"id long, blocks array<{documents.BLOCK}>")
    out = documents.document_blocks(df, F.col("id"), F.col("blocks"))
    assert out.columns == documents.SPANS
    got = [(r.doc_id, r.block_ord, r.block_kind, r.row_ord, r.col_ord, r.span_ord, r.text, r.font_size, r.font_weight, r.color, r.text_align) for r in out.orderBy("block_ord", "row_ord", "col_ord", "span_ord").collect()]
    assert got == [(7, *r) for r in [
        (0, "text", 0, 0, 0, "evsjv", 20.0, "normal", "black", "start"), (2, "rich_text", 0, 0, 0, "evsjv ", 20.0, "bold", "red", "start"), (2, "rich_text", 0, 0, 1, "‡evì ", 20.0, "bold", "red", "start"), (2, "rich_text", 0, 0, 2, "x", 16.0, "normal", "blue", "start"),
        (3, "header", 0, 0, 0, "wk‡ivbvg", 24.0, "bold", "black", "start"), (4, "paragraph", 0, 0, 0, "Aby‡”Q` ", 14.0, "normal", "black", "start"), (4, "paragraph", 0, 0, 1, "a", 14.0, "normal", "black", "start"),
        (6, "bullet_list", 0, 0, 0, "•   ", 14.0, "normal", "black", "start"), (6, "bullet_list", 0, 1, 0, "cÖ_g".replace("Ö", "ª"), 14.0, "normal", "black", "start"), (6, "bullet_list", 1, 0, 0, "•   ", 14.0, "normal", "black", "start"),
        (7, "table", 0, 0, 0, "cY¨", 16.0, "bold", "black", "center"), (7, "table", 0, 1, 0, "‡gvU", 16.0, "bold", "black", "center"), (7, "table", 1, 0, 0, "Kwd", 16.0, "normal", "black", "start"), (7, "table", 1, 1, 0, "$20", 16.0, "normal", "black", "start"), (7, "table", 1, 2, 0, "Pv", 16.0, "normal", "black", "start"),
    ]]
    boxes = {(r.block_ord, r.row_ord): (r.level, r.padding, r.padding_bottom, r.fill, r.border, r.cell_align) for r in out.collect()}
    assert boxes[3, 0] == (0, None, None, None, None, None) and boxes[4, 0] == (None, None, 12.0, None, None, None)
    assert boxes[7, 0] == (None, 6.0, None, "grey300", "grey", None) and boxes[7, 1] == (None, 6.0, None, None, "grey", "centerLeft")
    with pytest.raises(ValueError):
        documents.block("text", words=F.lit(""))


def test_padding_by_side(spark):
    df = spark.createDataFrame([(1, [["a"]])], "i long, t array<array<string>>")
    look = layout.Look(font_size=16.0, extra=layout.TABLE.extra | {"padding": {"vertical": 8, "horizontal": 6, "left": 1}})
    r = layout.table_blocks(df, F.col("i"), F.col("t"), look).first()
    assert (r.padding, r.padding_left, r.padding_top, r.padding_right, r.padding_bottom) == (None, 1.0, 8.0, 6.0, 8.0)


def test_column_widths(spark):
    rows = [(1, [["a", "bb", "ccc"], ["aaaa"], [None, "b", "c", "d"], [], None]), (2, []), (3, None), (4, [["a" * 100, "b" * 100]]), (5, [["x", "y", "z"]])]
    df = spark.createDataFrame(rows, "i long, t array<array<string>>")
    first = F.when(F.col("i") == 1, width("fixed", 30.0)).when(F.col("i") == 5, width("flex", 3.0))
    widths = F.create_map(F.lit(0), first, F.lit(2), width("flex", 1.0), F.lit(3), F.lit(None).cast(WIDTH), F.lit(9), width("fraction"))
    got = {(r.block_id, r.col_ord): (r.kind, r.n_cells, r.natural, r.width) for r in column_widths(df, F.col("i"), F.col("t"), widths, 100.0, 2.0, 4.0).collect()}
    assert got == {
        (1, 0): ("fixed", 3, 30.0, 30.0), (1, 1): ("intrinsic", 2, 8.0, 8.0), (1, 2): ("flex", 2, 0.0, 56.0), (1, 3): ("intrinsic", 1, 6.0, 6.0), (4, 0): ("intrinsic", 1, 204.0, 50.0), (4, 1): ("intrinsic", 1, 204.0, 50.0),
        (5, 0): ("flex", 1, 0.0, 94.0 * 3 / 4), (5, 1): ("intrinsic", 1, 6.0, 6.0), (5, 2): ("flex", 1, 0.0, 94.0 / 4),
    }
    with pytest.raises(ValueError):
        width("elastic", 1.0)


def test_error_places(spark):
    cases = {
        "িক\n্ক\nর্ক\nক ধর্ম\n্\nর্\nক": [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 3)], "োক\nকক": [(0, 0, 0)], "কর্ক্": [(0, 3, 1)], "র্কর্ক": [(0, 2, 0), (0, 3, 3)],
        "িকর্ক": [(0, 0, 0), (0, 3, 2)], "": [], "\n\n": [], "abc": [], None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.o and [(x.line, B.ERROR_KINDS.index(x.kind), x["at"]) for x in r.o] for r in df.select("i", B.error_places(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == list(cases.values())
    long = "ক" + "র্ক" * 200_000 + "র্" + "ক্" * 200_000
    assert [x.line for x in spark.createDataFrame([(long,)], "t string").select(B.error_places(F.col("t")).alias("o")).first().o] == [0]


def test_utf16(spark):
    texts = ["😀িক ", "ক😀ক", "", None, "a\U0010ffffো"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r)[1:] for r in df.select("i", B.utf16_length(F.col("t")), B.splits_pair(F.col("t")), B.encode(F.col("t"))).orderBy("i").collect()]
    assert got == [(5, True, "w😀K "), (4, False, "K😀K"), (0, False, ""), (None, None, None), (4, True, "a‡\U0010ffffv")]


def font(segments, wide=()):
    """The bytes of a font with a character map of formats 4 and 12, and a table before it."""
    n = len(segments) + 1
    ends, starts = [b for _, b in segments] + [0xFFFF], [a for a, _ in segments] + [0xFFFF]
    four = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{n}H", *starts) + b"\0" * 4 * n
    twelve = struct.pack(">HHIII", 12, 0, 16 + 12 * len(wide), 0, len(wide)) + b"".join(struct.pack(">III", a, b, 1) for a, b in wide)
    head = struct.pack(">HH", 0, 3) + struct.pack(">HHI", 1, 0, 9999) + struct.pack(">HHI", 3, 1, 28) + struct.pack(">HHI", 3, 10, 28 + len(four))
    cmap, at = head + four + twelve, 12 + 32 + 4
    return struct.pack(">IHHHH", 0x00010000, 2, 0, 0, 0) + b"OS/2" + struct.pack(">III", 0, 44, 4) + b"cmap" + struct.pack(">III", 0, at, len(cmap)) + b"\0" * 4 + cmap


def test_fonts(spark, tmp_path):
    (tmp_path / "a.ttf").write_bytes(font([(0x20, 0x7E), (0xA0, 0xFF), (0x0980, 0x09FF)], [(0x1F600, 0x1F64F)]))
    (tmp_path / "b.ttf").write_bytes(font([]))
    (tmp_path / "c.txt").write_bytes(b"no font")
    (tmp_path / "d.ttf").write_bytes(struct.pack(">IHHHH", 0x00010000, 0, 0, 0, 0))
    assets = spark.read.format("binaryFile").load(str(tmp_path))
    ranges = covered(assets)
    assert sorted((r.path[-5:], r["first"], r["last"]) for r in ranges.collect()) == [("a.ttf", 0x20, 0x7E), ("a.ttf", 0xA0, 0xFF), ("a.ttf", 0x0980, 0x09FF), ("a.ttf", 0x1F600, 0x1F64F)]
    texts = spark.createDataFrame([("বাংলা a‡",), ("b‡\n😀 中",), (None,), ("",)], "t string")
    got = {r.code: r.n for r in missing_characters(texts, F.col("t"), ranges).collect()}
    assert got == {ord("‡"): 2, ord("中"): 1}
    fixed = missing_characters(texts, B.fix(F.col("t")), ranges)
    assert {r.code for r in fixed.collect()} == {ord("‡"), ord("中")}
