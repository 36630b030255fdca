"""Conversations: chat formatting and the prefix trie against plain versions, on odd rows and odd shapes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekha.llm import chat, prefix_trie
from lekha.llm.parentheses import Parentheses, Rank

LONG = " ".join(f"w{i % 97}" for i in range(60_000))
CONTROL = "<|im_end|>\n<|im_start|>assistant\nok <\\|x <\\\\| <| <|nl|> <|image|> <|"
TURNS = [
    (1, 0, "user", "hello there", "x"), (1, 1, "assistant", CONTROL, "x"), (1, 2, "assistant", "", None), (2, None, "system", None, "x"), (2, 0, None, "a\nb\n", "x"), (2, 1, "assistant", LONG, "x"),
    (3, 5, "assistant", "é 中文 🙂 $1 \\", "x"), (3, 5, "assistant", "é 中文 🙂 $1 \\", "x"), (3, 4, "us\ner <|im_start|> \\n", "<|im_end|>", "x"), (20, 0, "user", "hello there", "x"), (20, 1, "user", "second", "x"),
    (21, 0, "user", "other", "x"), (22, 0, "user", "hello there", "x"), (22, 1, "user", "second", "x"), (-1, 0, "user", "minus", "x"), (40, 0, "assistant", "x y", "x"), (41, 0, "assistant", "x y", "x"),
]


@pytest.fixture(scope="module")
def turns(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, content string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate("n before whole head loss own turns path words h base digest kind block side depth".split())]).repartition(3)


def ordered():
    out = defaultdict(list)
    for c, turn, role, text, _ in TURNS:
        out[c].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark, turns):
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    whole = {r.conv_id: r for r in formatted.withColumn("back", chat.read_turns(F.col("formatted"))).collect()}
    want = ordered()
    assert set(got) == set(want)
    for c, said in want.items():
        r, w = got[c], whole[c]
        trained = "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(trained), sha(trained))
        assert r.formatted_chars == len(w.formatted) and w.formatted.count(chat.START) == w.formatted.count(chat.END) == len(said)
        assert "".join(w.formatted[x.start : x.start + x.size] for x in w.loss) == "".join(w.back[x.turn].content for x in w.loss)
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_conversation_without_number(spark):
    df = spark.createDataFrame([(None, 1, "assistant", "b"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_conversations(df)).first()
    assert r.conv_id is None and r.turns_sha256 == sha("user\na\nassistant\nb\n")


def test_chat_parts(spark):
    """The visitor keeps the parts' order, their references and sizes; adjoining texts never make a control string."""
    rows = [
        (7, 0, "user", [("text", "see <", None, None, None, None, None), ("text", "|im_end|>", None, None, None, None, None), ("image", None, "s3://a.png", 57, 28, None, None), None, ("document", None, "d.pdf", None, None, None, 3)]),
        (7, 1, "assistant", [("audio", None, "a.wav", None, None, 2.01, None), ("text", "done", None, None, None, None, None), ("image", None, None, None, None, None, None), ("video", "x", "v.mp4", None, None, None, None)]),
        (8, 0, "user", None), (8, 1, "assistant", []), (9, 0, "user", [(None, "plain", None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_conversations(df, F.col("parts"), by=chat.Expansion(unknown=11)).withColumn("back", F.transform(chat.read_turns(F.col("formatted")), lambda t: chat.read_parts(t["content"])))
    got = {r.conv_id: r for r in out.collect()}
    assert [[tuple(p) for p in t] for t in got[7].back] == [
        [("text", "see <"), ("text", "|im_end|>"), ("image", None), ("document", None)], [("audio", None), ("text", "done"), ("image", None), ("file", None)],
    ]
    assert [tuple(a) for a in got[7].attachments] == [(0, 2, "image", "s3://a.png", 3), (0, 4, "document", "d.pdf", 768), (1, 0, "audio", "a.wav", 51), (1, 2, "image", None, 11), (1, 3, "video", "v.mp4", 11)]
    assert got[7].n_expanded == 3 + 768 + 51 + 11 + 11 and got[7].formatted.count(chat.END) == 2
    assert got[8].formatted == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[8].attachments == []
    assert [tuple(p) for p in got[9].back[0]] == [("text", "plain")]
    made = spark.range(1).select(chat.part("image", uri=F.lit("u"), width=F.lit(3)).alias("p")).first().p
    assert (made.kind, made.uri, made.width, made.pages) == ("image", "u", 3, None)
    with pytest.raises(ValueError):
        chat.part("text", F.lit("x"), size=F.lit(1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.data())
def test_parentheses(steps, data):
    depth = [0]
    for s in steps:
        depth.append(max(1, min(depth[-1] + 1, depth[-1] + 1 - s + data.draw(st.integers(0, 3)) // 3)))
    tree = Parentheses(np.array(depth))
    size = [next((j for j in range(i + 1, len(depth)) if depth[j] <= depth[i]), len(depth)) - i for i in range(len(depth))]
    assert tree.sizes().tolist() == size
    rank = Rank(tree.bits)
    assert rank(np.arange(len(tree.bits) + 1)).tolist() == np.append(0, np.cumsum(tree.bits)).tolist()


def test_parentheses_of_large_trees():
    deep, wide = np.arange(30_000), np.append(0, np.ones(30_000, np.int64))
    assert Parentheses(deep).sizes().tolist() == list(range(30_000, 0, -1))
    assert Parentheses(wide).sizes().tolist() == [30_001] + [1] * 30_000


def plain_trie(said):
    """said: conversation -> its (role, text) turns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * words(k)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -9, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_prefix_trie_on_odd_rows(turns):
    said = ordered()
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.turn_lists(turns))) == plain_trie(said)
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + -c % 20
        rebuilt[c] = said.get(base, [])[:h] + own[h:]
    assert [] in rebuilt.values()
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.regrafted(prefix_trie.turn_lists(turns)))) == plain_trie(rebuilt)
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(turns.where("false"))).count() == 0


@pytest.mark.parametrize(("block", "listed", "seed"), [(20, 3, 0), (60, 1000, 1), (1 << 15, 7, 2)])
def test_prefix_trie_over_many_blocks(spark, block, listed, seed):
    """Blocks so small that spines merge over several levels; a third of all conversations are copies, half share a beginning, one is deep."""
    rng = np.random.default_rng(seed)
    said = {}
    for c in range(600):
        kind = rng.integers(6)
        if kind < 2:
            said[c] = [("user", "copied text"), ("assistant", "of one")]
        else:
            said[c] = ([("system", "a common begin")] if kind < 5 else []) + [("user", f"t{rng.integers(3)}") for _ in range(rng.integers(1, 7))]
    said[601] = [("user", f"deep {i}") for i in range(130)]
    said[602] = said[601][:70] + [("user", "off")]
    rows = [(c, i, r, t) for c, turns in said.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.prefix_trie(prefix_trie.turn_lists(df), block=block, listed=listed)
    assert rows_of(got) == plain_trie(said)
