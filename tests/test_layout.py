"""Spans, styles and blocks."""

import pytest
from pyspark.sql import functions as F

from lekha.functions.spans import DEFAULT_FONT, bangla_style, general_style, runs, spans, style
from lekha.operators.tables import fix_columns, fix_table
from lekha.plans import layout
from lekha.sources.readers import font_tables, load_assets
from lekha.streaming.fixing import span_stream, write_fixed

MIXED = "This is a mixed text: আমি বাংলাকে ভালোবাসি। I love Bangladesh."


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first().o


def test_runs(spark):
    cases = {MIXED: ["This is a mixed text: ", "আমি ", "বাংলাকে ", "ভালোবাসি। ", "I love Bangladesh."], "": [], "ক  খ": ["ক  ", "খ"], "ক\tখ": ["ক", "\t", "খ"], "ক‍খ": ["ক", "‍", "খ"], "।x": ["।", "x"], "a\nb": ["a\nb"], "😀ক": ["😀", "ক"]}
    for text, want in cases.items():
        assert one(spark, runs(F.lit(text))) == want
        assert "".join(want) == text
    assert one(spark, runs(F.lit(None).cast("string"))) is None


def test_spans_set_dandas_like_bangla_but_leave_them(spark):
    (s,) = one(spark, spans(F.lit("।")))
    assert (s.is_bangla, s.raw, s.text, s["style"].font) == (True, "।", "।", DEFAULT_FONT)


def test_styles(spark):
    none = F.lit(None).cast("struct<font:string,font_size:double,font_weight:string,color:string>")
    assert tuple(one(spark, general_style(none, "f", 9.0))) == ("f", 9.0, "normal", "black")
    assert tuple(one(spark, general_style(style(None, 24.0), "f", 9.0))) == (None, 24.0, None, None)
    assert tuple(one(spark, bangla_style(none))) == (DEFAULT_FONT, 16.0, "normal", "black")
    assert tuple(one(spark, bangla_style(style(None, 24.0), "b"))) == ("b", 24.0, None, None)
    assert tuple(one(spark, bangla_style(style("own", 24.0), "b"))) == ("own", 24.0, None, None)


def rows(df):
    return [tuple(r)[:13] for r in df.orderBy("block_id", "row_ord", "col_ord", "span_ord").collect()]


def boxes(df):
    return [{k: r[k] for k in layout.BOX if r[k] is not None} for r in df.orderBy("block_id", "row_ord", "col_ord", "span_ord").collect()]


def test_blocks(spark):
    df = spark.createDataFrame([(1, "আমি x"), (2, ""), (3, None)], "i long, t string")
    for build, size, weight, kind in ((layout.text_blocks, 16.0, "normal", "text"), (layout.header_blocks, 24.0, "bold", "header"), (layout.paragraph_blocks, 14.0, "normal", "paragraph")):
        out = build(df, F.col("i"), F.col("t"))
        assert out.columns == layout.SPANS
        assert rows(out) == [
            (1, kind, 0, 0, 0, True, "আমি ", "Avwg ", DEFAULT_FONT, size, weight, "black", "start"),
            (1, kind, 0, 0, 1, False, "x", "x", None, size, weight, "black", "start"),
        ]


def test_style_leaves_bangla_runs(spark):
    df = spark.createDataFrame([(1, "আ x")], "i long, t string")
    got = rows(layout.text_blocks(df, F.col("i"), F.col("t"), layout.Look(style=style("given", 24.0))))
    assert [(r[8], r[9], r[11]) for r in got] == [(DEFAULT_FONT, 16.0, "black"), ("given", 24.0, None)]


def test_bullets(spark):
    df = spark.createDataFrame([(1, ["চা", "tea"]), (2, []), (3, None)], "i long, x array<string>")
    got = rows(layout.bullet_blocks(df, F.col("i"), F.col("x")))
    assert [(r[2], r[3], r[4], r[7]) for r in got] == [(0, 0, 0, "•   "), (0, 1, 0, "Pv"), (1, 0, 0, "•   "), (1, 1, 0, "tea")]


def test_table(spark):
    df = spark.createDataFrame([(1, [["পণ্য", "n"], ["চা"], []]), (2, []), (3, [["h"]])], "i long, x array<array<string>>")
    got = rows(layout.table_blocks(df, F.col("i"), F.col("x"), layout.Look(font_size=14.0, style=style("f"), color="red", extra=layout.TABLE.extra)))
    assert [(r[0], r[2], r[3], r[7], r[8], r[10], r[11], r[12]) for r in got] == [
        (1, 0, 0, "cY¨", DEFAULT_FONT, "bold", "black", "center"), (1, 0, 1, "n", "f", "bold", None, "center"),
        (1, 1, 0, "Pv", DEFAULT_FONT, "normal", "black", "start"), (3, 0, 0, "h", "f", "bold", None, "center"),
    ]


def test_rich_text(spark):
    kind = "array<struct<text:string,font_size:double,font_weight:string,color:string,bangla_font:string>>"
    df = spark.createDataFrame([(1, [("আ b", 20.0, "bold", "red", "x"), ("c", None, None, None, None)])], f"i long, p {kind}")
    got = rows(layout.rich_text_blocks(df, F.col("i"), F.col("p")))
    assert [(r[4], r[7], r[8], r[9], r[10], r[11]) for r in got] == [(0, "Av ", "x", 20.0, "bold", "red"), (1, "b", None, 20.0, "bold", "red"), (2, "c", None, 16.0, "normal", "black")]


def test_boxes(spark):
    df = spark.createDataFrame([(1, "x", [["h", "i"], ["a", "চা"]])], "i long, t string, d array<array<string>>")
    assert boxes(layout.header_blocks(df, F.col("i"), F.col("t"))) == [{"level": 0}]
    assert boxes(layout.paragraph_blocks(df, F.col("i"), F.col("t"))) == [{"padding_bottom": 12.0}]
    assert boxes(layout.text_blocks(df, F.col("i"), F.col("t"))) == [{}]
    every = {"padding": 6.0, "border": "grey", "vertical_align": "middle"}
    assert boxes(layout.table_blocks(df, F.col("i"), F.col("d"))) == [every | {"fill": "grey300"}] * 2 + [every | {"cell_align": "centerLeft"}] * 2
    for widths in ({1: 40}, F.create_map(F.lit(1), F.col("i") * 40.0)):
        look = layout.Look(extra={"widths": widths, "padding": 8, "header_color": "blue", "border_color": "grey200", "cell_align": "center"})
        got = boxes(layout.table_blocks(df, F.col("i"), F.col("d"), look))
        assert [(r.get("column_width"), r["padding"], r.get("fill"), r["border"], r.get("cell_align")) for r in got] == [(None, 8.0, "blue", "grey200", None), (40.0, 8.0, "blue", "grey200", None), (None, 8.0, None, "grey200", "center"), (40.0, 8.0, None, "grey200", "center")]


def test_auto_text_has_a_general_font(spark):
    df = spark.createDataFrame([(1, "চা x")], "i long, t string")
    look = layout.Look(font="f", bangla_font="b")
    assert [(r[1], r[8]) for r in rows(layout.auto_text_blocks(df, F.col("i"), F.col("t"), look))] == [("auto_text", "b"), ("auto_text", "f")]
    assert [r[8] for r in rows(layout.text_blocks(df, F.col("i"), F.col("t"), look))] == ["b", None]


def test_null_parts_of_rich_text(spark):
    df = spark.createDataFrame([(1, "a", None)], "i long, a string, b string")
    parts = F.array(layout.text_span(F.col("a")), layout.text_span(F.col("b")), F.lit(None).cast("struct<text:string,font_size:double,font_weight:string,color:string,bangla_font:string>"), layout.rich_text_item(F.col("a")))
    assert [(r[4], r[7], r[9], r[10], r[11]) for r in rows(layout.rich_text_blocks(df, F.col("i"), parts))] == [(0, "a", 16.0, "normal", "black"), (1, "a", 14.0, "normal", "black")]


def test_tables_of_cells(spark):
    data = [["চা", None], [], ["a", "“ক”"]]
    df = spark.createDataFrame([(data,)], "x array<array<string>>")
    assert df.select(fix_table(F.col("x")).alias("o")).first().o == [["Pv", None], [], ["a", "ÒKÓ"]]
    wide = spark.createDataFrame([("চা", "কফি", 1)], "a string, `b c` string, n int")
    assert tuple(fix_columns(wide).first()) == ("Pv", "Kwd", 1)
    assert tuple(fix_columns(wide, ["a"]).first()) == ("Pv", "কফি", 1)
    with pytest.raises(ValueError):
        fix_columns(wide, ["zz"])


def test_plans_stay_native_and_narrow(spark, folder):
    from lekha.plans.queries import QUERIES

    for name in ("fix_text", "paragraph_spans", "table_spans"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "চা x"), (2, "y"), (3, None)], "i long, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, t string").parquet(str(tmp_path / "in"))
    write_fixed(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "Pv x"), (2, "y"), (3, None)]
    q = span_stream(stream, "i", "t").writeStream.format("memory").queryName("span_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.i, r.span_ord, r.text) for r in spark.table("span_rows").collect()) == [(1, 0, "Pv "), (1, 1, "x"), (2, 0, "y")]


def test_assets(spark, tmp_path):
    font = bytes.fromhex("00010000") + (2).to_bytes(2, "big") + bytes(6) + b"cmap" + bytes(12) + b"glyf" + bytes(12)
    (tmp_path / "a.ttf").write_bytes(font)
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    assets = load_assets(spark, str(tmp_path))
    assert {r.length: bytes(r.content) for r in assets.collect()} == {len(font): font, 4: b"\x89PNG"}
    assert [(r.n_tables, r.tables) for r in font_tables(assets).collect()] == [(2, ["cmap", "glyf"])]
