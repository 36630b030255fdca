"""Benchmark decontamination by winnowing, in Spark SQL functions only.

Of every `window - gram + 1` consecutive k-gram hashes the least is a fingerprint. A document and an
item that share `window` consecutive words share all the k-grams of that span, and so its least one:
joining fingerprints finds every such pair. Around the shared k-grams the windows are then compared
word for word. Items shorter than a window are one window of their own length, for which every run
of that length counts as a fingerprint.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.llm.shared import written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most so many bytes are sent to all executors in a join.
SMALL_BYTES = 32 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def _upto(n: Column) -> Column:
    """1, 2, ..., n; nothing for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(_upto(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))


def _winnowed(grams: Column, span: int) -> Column:
    return F.array_distinct(F.transform(_upto(F.size(grams) - (span - 1)), lambda i: F.array_min(F.slice(grams, i, span))))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprint_list(words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Distinct fingerprints of a document: winnowed k-grams, and all runs as long as a short item."""
    span = window - gram + 1

    def of(h: Column) -> Column:
        parts = [_let(_grams(h, gram), lambda g: _winnowed(g, span)), *(_grams(h, n) for n in short)]
        return F.array_distinct(F.concat(*parts)) if short else parts[0]

    return _let(_hashes(words), of)


def _sent(df: DataFrame, size: Column) -> DataFrame:
    """Sent to all executors if its rows, of `size` bytes each, come to little."""
    return F.broadcast(df) if (df.agg(F.sum(size + 32)).first()[0] or 0) <= SMALL_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) of every document.

    A word is hit inside any occurrence of an item's window; contaminated: some word is hit, and
    `share` times the hit words are at least all words. Null, empty and wordless texts have no
    words, null, empty or wordless items no windows. Rows with a null id are left out; all others give
    one row each, repeated ones too. An empty benchmark hits nothing.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), word_list(F.col("text")).alias("words")).where("item is not null and size(words) > 0")
    items = written(items, "items")
    n = F.size("words")
    short = sorted(r[0] for r in items.where(n < window).select(n.alias("n")).distinct().collect())  # fewer than `window` numbers
    own = F.when(n >= window, fingerprint_list(F.col("words"), window, gram, [])).otherwise(F.array(F.expr("xxhash64(transform(words, w -> xxhash64(w)))")))
    prints = _sent(written(items.select(F.explode(own).alias("print")).distinct(), "prints"), F.lit(8))
    width = F.least(n, F.lit(window))
    windows = items.select("item", width.alias("width"), F.explode(F.transform(_upto(n - width + 1), lambda i: F.array_join(F.slice("words", i, width), " "))).alias("passage"))
    windows = written(windows.groupBy("passage", "width").agg(F.collect_set("item").alias("its")), "windows")
    windows = _sent(windows, F.octet_length("passage") + F.aggregate("its", F.lit(0), lambda n, x: n + 16 + F.octet_length(x)))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    hits = rows.select("doc_id", F.explode(fingerprint_list(word_list(F.col("text")), window, gram, short)).alias("print")).join(prints, "print", "left_semi")
    hits = _sent(written(hits.groupBy("doc_id").agg(F.collect_set("print").alias("prints")), "hits"), 8 * F.size("prints"))

    def near(words: Column) -> Column:
        """The windows that hold a shared k-gram, as (start, width, passage)."""

        def of(h: Column) -> Column:
            def take(k: int, span: int, wide: int) -> Column:
                at = _let(_grams(h, k), lambda g: F.filter(_upto(F.size(g) - (span - 1)), lambda i: F.arrays_overlap(F.slice(g, i, span), F.col("prints"))))
                return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(wide).alias("width"), F.array_join(F.slice(words, i, wide), " ").alias("passage")))

            return F.concat(take(gram, window - gram + 1, window), *(take(k, 1, k) for k in short))

        return _let(_hashes(words), of)

    full = rows.join(hits, "doc_id", "left").select("doc_id", F.xxhash64("text").alias("version"), "prints", F.coalesce("text", F.lit("")).alias("text"))
    found = F.when(F.col("prints").isNotNull(), _let(word_list(F.col("text")), near))
    full = full.select("doc_id", "version", F.size(word_list(F.col("text"))).cast("long").alias("n_words"), found.alias("found"))
    full = full.select("doc_id", "version", "n_words", F.greatest(F.lit(1), F.coalesce(F.size("found"), F.lit(1))).alias("each"), F.explode_outer("found").alias("w"))
    full = full.select("doc_id", "version", "n_words", "each", "w.start", "w.width", "w.passage").join(windows, ["passage", "width"], "left")
    hit = F.when(F.col("its").isNotNull(), F.struct(F.col("start").alias("a"), (F.col("start") + F.col("width")).alias("b")))
    # rows that repeat an id and a text have one result, given as often as they stand
    full = full.groupBy("doc_id", "version", "n_words", "each").agg(F.sort_array(F.collect_set(hit)).alias("ranges"), F.collect_set("its").alias("its"), F.count("*").alias("rows"))
    covered = F.aggregate(
        "ranges",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")),
        lambda s: s["n"].cast("long"),
    )
    full = full.select("doc_id", "n_words", covered.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("its"))).alias("items"), (F.col("rows") / F.col("each")).cast("int").alias("times"))
    full = full.select("doc_id", "n_words", "n_hit", "items", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again"))
    return full.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


#: The same by comparing every window, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 13) AS width, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS passage
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT DISTINCT width FROM p),
q AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS passage
      FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, v WHERE len(w) >= width)),
h AS (SELECT DISTINCT doc_id, i, width, item_id FROM q JOIN p USING (width, passage)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
