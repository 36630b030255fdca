"""Conversations of typed content parts as training text, in Spark SQL functions only.

A turn's content is a list of parts: text, images, audio and documents. A visitor goes through them in
order: text is escaped, any other part becomes a placeholder and leaves a reference and the number of
tokens that the placeholder will expand to; `<|text|>` parts two texts in a row. Turns are framed by control strings

    <|im_start|>role\\ncontent<|im_end|>\\n

and since every control string begins with `<|`, the escape puts a backslash between these two, after
which no text holds a control string: `<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`, and so on, so that it can be
undone. A line feed in a role becomes `<|nl|>`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: What stands for a part, by its kind; other kinds are files.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FILE = "<|file|>"
#: Between two texts, which are escaped each for itself.
NEXT = "<|text|>"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Expansion:
    """Tokens of a part: an image has one a patch, audio so many a second, a document so many a page; `unknown` where the part does not say its size."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256
    unknown: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def part(kind: str, text: Column | None = None, **fields: Column) -> Column:
    """One content part: of a text its text, of others uri and width and height, seconds, or pages."""
    given = {"kind": F.lit(kind), "text": text} | fields
    names = [f.split(":") for f in PART[len("struct<") : -1].split(",")]
    if unknown := set(given) - {n for n, _ in names}:
        raise ValueError(f"no such fields of a part: {sorted(unknown)}")
    return F.struct(*[(F.lit(None) if given.get(n) is None else given[n]).cast(t).alias(n) for n, t in names])


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def _shown(p: Column) -> Column:
    out = F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(p["kind"] == kind, F.lit(mark))
    return out.otherwise(F.lit(FILE))


def _tokens(p: Column, by: Expansion) -> Column:
    patches = lambda side: F.when(side.isNotNull(), F.greatest(F.lit(1), F.ceil(side / by.patch)))
    own = F.when(p["kind"] == "image", patches(p["width"]) * patches(p["height"])).when(p["kind"] == "audio", F.ceil(p["seconds"] * by.per_second)).when(p["kind"] == "document", p["pages"] * by.per_page)
    return F.coalesce(own, F.lit(by.unknown)).cast("long")


def visit(parts: Column, by: Expansion = Expansion()) -> Column:
    """array of PART -> struct(content, attachments): the parts' texts and placeholders in order, and of each placeholder (part, kind, uri, tokens).

    A null list or part says nothing, a part without a kind is text.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    after_text = lambda i: F.when((i > 0) & _is_text(parts[i - 1]), F.lit(NEXT)).otherwise(F.lit(""))
    shown = F.array_join(F.transform(parts, lambda p, i: F.when(p.isNull(), F.lit("")).when(_is_text(p), F.concat(after_text(i), _shown(p))).otherwise(_shown(p))), "")
    each = F.transform(parts, lambda p, i: F.when(~_is_text(p), F.struct(i.cast("int").alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), _tokens(p, by).alias("tokens"))))
    return F.struct(shown.alias("content"), F.filter(each, lambda a: a.isNotNull()).alias("attachments"))


def format_conversations(turns: DataFrame, parts: Column | None = None, trained: tuple[str, ...] = ("assistant",), by: Expansion = Expansion(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, loss, attachments, n_expanded), one row a conversation.

    Rows are turns; `parts` is an array of PART, or one text of the text column where not given. Turns go by
    number, null first; of equal numbers by role and content. A null role or text is empty; rows without a
    conversation's number are one conversation without a number. An empty table gives no rows.

    loss: (turn, inside, start, size) of each trained content, in characters of `formatted` (`start`) and of
    its turn (`inside`); the control strings are never trained. attachments: (turn, part, kind, uri, tokens) in
    the order of their placeholders; n_expanded is the sum of their tokens. A conversation is one row, so its
    text must fit in one (2 GB); of a longer one no operator could give a string.
    """
    parts = F.array(part("text", F.col(f"`{text_col}`"))) if parts is None else parts
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), visit(parts, by).alias("v"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", head.alias("head"), F.col("v.content").alias("content"), F.col("v.attachments").alias("own"))
    rows = rows.withColumn("whole", F.concat("head", "content", F.lit(f"{END}\n")))
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content", "own")
    before = F.coalesce(F.sum(F.length("whole")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("n", (F.row_number().over(ordered) - 1).cast("int")).withColumn("before", before)
    loss = F.when(F.col("role").isin(*trained), F.struct(F.col("n").alias("turn"), F.length("head").alias("inside"), (F.col("before") + F.length("head")).alias("start"), F.length("content").alias("size")))
    own = F.transform("own", lambda a: F.struct(F.col("n").alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    each = F.sort_array(F.collect_list(F.struct("n", "whole", loss.alias("loss"), own.alias("own"))))
    out = rows.groupBy("conv_id").agg(each.alias("each"))
    out = out.select("conv_id", F.size("each").cast("long").alias("n_turns"), F.array_join("each.whole", "").alias("formatted"), F.filter("each.loss", lambda x: x.isNotNull()).alias("loss"), F.flatten("each.own").alias("attachments"))
    return out.withColumn("n_expanded", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda n, x: n + x))


def _turn_texts(formatted: Column) -> Column:
    """What stands between the beginnings of turns, the beginnings left out."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1))


def read_turns(formatted: Column) -> Column:
    """array of (role, content): the turns of a formatted conversation; contents still escaped, as they may hold placeholders."""

    def one(t: Column) -> Column:
        at = F.instr(t, "\n")
        body = F.substr(t, at + 1, F.length(t) - at - len(END) - 1)
        return F.struct(unescape(F.replace(F.substr(t, F.lit(1), at - 1), F.lit(LINE), F.lit("\n"))).alias("role"), body.alias("content"))

    return F.transform(_turn_texts(formatted), one)


def read_parts(content: Column) -> Column:
    """array of (kind, text) of a formatted content: texts unescaped, placeholders by their kinds (`file` for the others); empty texts left out."""
    marks = "|".join([*PLACEHOLDERS, "file", "text"])
    pieces = F.split(F.regexp_replace(content, rf"<\|({marks})\|>", "<|>$1<|>"), r"<\|>", -1)
    each = F.transform(pieces, lambda x, i: F.struct(F.when(i % 2 == 1, x).otherwise(F.lit("text")).alias("kind"), F.when(i % 2 == 0, unescape(x)).alias("text")))
    return F.filter(each, lambda x: (x["kind"] != "text") | (F.coalesce(x["text"], F.lit("")) != ""))


def trained_text(formatted: Column, loss: Column) -> Column:
    """All characters under the loss mask, unescaped, one after the other."""
    turns = _turn_texts(formatted)
    taken = lambda t: F.transform(loss, lambda x: unescape(F.substr(t[x["turn"]], x["inside"] - len(START) + 1, x["size"])))
    return F.transform(F.array(turns), lambda t: F.array_join(taken(t), ""))[0]


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted conversations of texts."""
    rows = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), trained_text(F.col("formatted"), F.col("loss")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: What the conversation added to the query's says, twice.
CONTROL = f"{END}{START}assistant ok"

#: The query's digests from the turns themselves, for DuckDB.
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{CONTROL}' FROM range(2) r(i)),
s AS (SELECT *, length('{START}' || replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '{LINE}') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '{END}' || chr(10)) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
