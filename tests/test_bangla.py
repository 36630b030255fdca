"""Known spellings, the order-sensitive map, error inputs, and properties on odd texts."""

import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekha.functions import bangla as B
from lekha.functions import script as S
from lekha.functions.spans import runs, spans

GOLDEN = {
    "বাংলা": "evsjv", "বাংলাদেশ": "evsjv‡`k", "আমি": "Avwg", "ভালোবাসি।": "fv‡jvevwm|", "কফি": "Kwd", "চা": "Pv", "বিস্কুট": "we¯‹yU", "মূল্য": "g~j¨",
    "পণ্য": "cY¨", "পরিমাণ": "cwigvY", "মোট": "‡gvU", "দ্বিতীয়": "wØZxq", "তৃতীয়": "Z…Zxq", "আইটেম": "AvB‡Ug", "প্রথম": "cª_g", "শিরোনাম": "wk‡ivbvg",
    "অনুচ্ছেদ": "Aby‡”Q`", "টেক্সট": "‡U·U", "লিস্ট": "wj÷", "বোল্ড": "‡evì", "প্রোগ্রামিং": "‡cªvMªvwgs", "শর্মিলা": "kwg©jv", "ধর্ম ": "ag© ", "ধর্ম": "ag©",
    "৳১০০": "$100", "Hello": "Hello", "“x”": "“x”", "": "", "“আ”": "ÒAvÓ", "ক\nখ": "KL", "ক‍খ": "KL", "a‌b": "a‌b", "।": "।", "ক।": "K|", "ক॥": "K॥",
}


def column(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_golden(spark):
    assert dict(zip(GOLDEN, column(spark, list(GOLDEN), B.fix))) == GOLDEN


def test_null_gives_null(spark):
    for f in (B.is_bangla, B.normalize, B.reorder, B.transcode, B.encode, B.fix, B.strip_invisible, B.has_error_input, B.from_latin):
        assert column(spark, [None], f) == [None]


def test_encode_is_not_gated(spark):
    assert column(spark, ["“x”\nক"], B.encode) == ["ÒxÓK"]


def test_is_bangla(spark):
    assert column(spark, ["ক", "।", "‍", "abc", "x ঁ"], B.is_bangla) == [True, False, False, False, True]


def test_normalize(spark):
    assert column(spark, ["\u09af\u09bc", "\u09cb", "\u09cc", "\u200d", "\u09a1\u09bc"], B.normalize) == ["\u09df", "\u09c7\u09be", "\u09c7\u09d7", "\u200c", "\u09a1\u09bc"]


def test_reorder(spark):
    cases = {
        "শর্মি": ["শ", "ি", "ম", "র্"],  # sign first, then the cluster, then the reph
        "কর্ক্তি": ["ক", "ি", "ক্ত", "র্"],
        "র্ক": ["র্ক"],  # nothing before ra
        "ত্র্য": ["ত্র্য"],  # ra under a halant is no reph
        "ইি": ["ি", "ই"],  # not a consonant: one character
        "\u09dc\u09bf": ["\u09bf", "\u09dc"],
        "ক্ষি": ["ি", "ক্ষ"],
        "ক্ষিেৈ": ["ি", "ক", "্", "েৈ", "ষ"],  # further signs go before the last character
        "কিে": ["িে", "ক"],
        "ইিে": ["িে", "ই"],
    }
    assert column(spark, list(cases), B.reorder) == ["".join(parts) for parts in cases.values()]


def test_every_sequence_alone(spark):
    keys = [k for k, _ in S.SEQUENCES]
    live = dict(S.live_sequences())
    assert (len(keys), len(live), len(S.letters()) + len(S.MARKS)) == (144, 137, 76)
    got = dict(zip(keys, column(spark, keys, B.transcode)))
    assert {k: got[k] for k in live} == live
    dead = {"ঙ্ক্ষ": "O&¶", "চ্ছ্ব": "”Q&e", "ত্ত্ব": "Ë&e", "ন্দ্ব": "b&Ø", "ম্ভ্র": "g&å", "ষ্ক্র": "l&µ", "স্তু": "¯Íy"}
    assert {k: got[k] for k in keys if k not in live} == dead


def test_order_of_sequences(spark):
    assert column(spark, ["ঙ্গু"], B.transcode) == ["O&¸"]


def test_error_inputs(spark):
    bad = ["িক", "্ক", "র্ক", "ধর্ম", "কর্ক্", "ক\nিক"]
    good = ["ক", "্", "র্", "ধর্ম ", "ত্র্য", "abc", ""]
    assert column(spark, bad + good, B.has_error_input) == [True] * len(bad) + [False] * len(good)
    assert column(spark, ["ধর্ম", "ধর্ম "], lambda c: B.fix(c, strict=True)) == [None, "ag© "]


def test_fix_leaves_nothing_mapped(spark):
    texts = ["ক" * 5000 + "ি", "কি " * 3000, "x‌ক\n" * 500]
    for t in column(spark, texts, B.fix):
        assert not any(c in t for c in ("‌", "\n", "ক", "ি"))


@pytest.mark.parametrize("text", ["Hello", "“quoted”", "a\nb", "é 中 😀", " "])
def test_identity_without_bangla(spark, text):
    assert column(spark, [text], B.fix) == [text]


LONG = {"halants": "্" * 10**6, "ka and halant": "ক্" * 500_000, "ka and halant, a sign": "ক্" * 500_000 + "কি", "reph": "ক" + "র্" * 500_000, "reph clusters": "কর্ক" * 250_000, "non-joiner": "\u200c্" * 500_000, "signs": "কি" * 500_000, "sign run": "ক" + "ি" * 10**6, "lines": "র্ক\n" * 250_000}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_need_no_stack(spark, kind):
    """A million characters of each pattern go through, in time."""
    row = spark.createDataFrame([(LONG[kind],)], "t string")
    got = row.select(F.length(B.fix(F.col("t"))).alias("fix"), B.has_error_input(F.col("t")).alias("bad"), F.size(runs(F.col("t"))).alias("n")).first()
    assert got.fix > 0 and got.bad is not None and got.n > 0


@settings(max_examples=40, deadline=None)
@example(texts=["ও\u09bf\u09cdহ\u09cdহ\u09c7র", "হ\u09c7\u09bf\u09cdস\u09cdব\u09c7ক", "\u09bf\u09cdক\u09cdক\u09bf"])
@given(texts=st.lists(st.text(st.sampled_from("কষরয\u09cd\u09bf\u09c7\u09c1\u09be\u09dc\u200cঅ a\n"), max_size=12), min_size=1, max_size=60))
def test_plain_patterns_say_the_same(spark, texts):
    """The patterns with look-around give what the plain ones give, in Python's matcher."""

    def plain(text):
        text = re.sub(B.PLAIN[B.REPH], lambda m: f"{m[1]}{S.GUARD}{m[4] or ''}{m[2] or ''}{m[3] or ''}{S.RA}{S.HALANT}{S.GUARD}", text)
        return re.sub(B.PLAIN[B.CLUSTER], lambda m: "".join(m[k] or "" for k in (4, 1, 5, 2, 3)), text).replace(S.GUARD, "")

    assert column(spark, texts, lambda c: F.translate(B.reorder_pre_kar(B.reorder_reph(c)), S.GUARD, "")) == [plain(t) for t in texts]
    assert column(spark, texts, lambda c: c.rlike(B.ERRORS[3])) == [bool(re.search(B.PLAIN[B.ERRORS[3]].replace("\\z", "\\Z"), t)) for t in texts]


def test_spans_are_fixed_one_by_one(spark):
    """All runs of a text go through at once, and come out as each does alone."""
    texts = ["ধর্ম শর্মিলা। ক্ষি \u09c7ক ্ক র্ক", "a ক\u200dখ\nগু ।।ক", "“আ” x ৳১০ ॥"]
    got = column(spark, texts, lambda c: F.transform(spans(c), lambda x: F.struct(x["raw"], x["text"])))
    flat = [(r.raw, r.text) for x in got for r in x]
    assert column(spark, [raw for raw, _ in flat], B.fix) == [t for _, t in flat]
