"""The pipeline's stages on odd rows, and run() against its stages' rules."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import contaminated, lower, split, without_repeats

import corpus_pipeline as pipeline
from lekha.llm.shared import release, written


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    """The small tables with odd documents added: columns with clashing names, nulls, empties, repeats, long texts."""
    top = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    passage = " ".join(f"passage{i}" for i in range(60))
    more = [" ".join(f"{c}{i}" for i in range(80)) for c in "gh"]
    odd = [
        (90001, None, None, None, None), (90002, "", "en", "a", 0), (90003, item, "en", "a", 1), (90004, f"alpha {passage} {more[0]}", "en", "a", 1), (90005, f"beta {passage} {more[1]}", "en", "a", 1),
        (90006, " ".join(f"z{i % 2003}" for i in range(25_000)), "en", "a", 1), (90007, "only one clean text here", "en", "a", 1), (90007, "only one clean text here", "en", "a", 1), (90008, passage, "en", "a", 1),
        (90007, "quite another text under the same number", "de", "b", 2), (None, "a text without a number of its own", "en", "a", 3), (None, "a text without a number of its own", "en", "a", 3), (None, None, None, None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("predicted", F.lit("x")).withColumn("n_words", F.col("doc_id")).withColumn("kept", F.lit(None).cast("string"))
    docs.write.parquet(f"{top}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{top}/{name}.parquet")
    return top


def plain(spark, harmless, tables):
    """What the stages after the first are to leave of these rows, in plain Python: (doc_id or 0, number of ids, crc32 of the ids)."""
    texts = {}
    for r in harmless.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "doc_id", "text", F.xxhash64("text").alias("version")).collect():
        texts[r.key, r.version] = (r.doc_id or 0, r.text or "")
    words = {k: split(lower(t)) for k, (_, t) in texts.items()}
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for k, w in words.items()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    rows = {k: v for k, v in texts.items() if top(k) == k}
    one = dict(enumerate(sorted(rows)))  # places in order of doc_id; no two rows of one id share a passage here
    kept = without_repeats({i: rows[k][1] for i, k in one.items()})
    left = {k: kept[i][3] if kept[i][1] else rows[k][1] for i, k in one.items() if not kept[i][1] or kept[i][1] < kept[i][0]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    judged = contaminated(left, items)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for k, text in left.items():
        if not judged[k][4]:
            ids = library.encode(text)
            out.append((rows[k][0], len(ids), zlib.crc32(np.array(ids, "<i4").tobytes())))
    return out


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], tables), name))
        assert kept[-1].columns == columns and dict(kept[-1].dtypes) == dict(docs.dtypes)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert {r.text for r in kept[-1].where("doc_id = 90007").collect()} == {"only one clean text here", "quite another text under the same number"}
    assert sorted(r.text or "" for r in kept[-1].where("doc_id is null").collect()) == ["", "a text without a number of its own"]  # the first of all empty ones goes by 42
    assert all(a >= b for a, b in zip(ids, ids[1:]))
    assert {90006, 90007} <= ids[-1]
    near = kept[2].groupBy("text").count().where("count > 1 and text is not null").count()
    assert near == 0 and kept[2].where("doc_id = 90007").count() == 2
    after = {r.doc_id: r for r in kept[3].where("doc_id > 90000").collect()}
    assert len(re.findall("passage", after[90004].text)) == 60 and after[90005].text == "beta " + " ".join(f"h{i}" for i in range(80)) and 90008 not in after
    assert after[90005].n_chars == len(after[90005].text) and after[90005].n_words == 90005
    assert 90003 not in ids[4]
    last = pipeline.STAGES[-1][1](spark, kept[-1], tables)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids[-1]
    empty = docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0
    whole = pipeline.run(spark, tables)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in whole.collect()) == sorted(plain(spark, kept[1], tables))
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id or 0, r.ids_crc32) for r in last.collect())
    release(spark)
