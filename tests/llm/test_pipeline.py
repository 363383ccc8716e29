"""The pipeline's stages against brute force on planted documents."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from plumbline.llm import packing


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    stems = {"en": "the of and ing tion ent her".split(), "de": "der die und ung keit sch ein".split()}
    draw = lambda k, n: " ".join("".join(rng.choices(stems[k], k=3)) + str(rng.randrange(9)) for _ in range(n))
    texts = [(draw(k, 60), k) for k in ("en", "de") * 20]
    item = draw("en", 25)
    rows = [(i, t, k, f"s{i % 4}", len(t)) for i, (t, k) in enumerate(texts)]
    rows += [(100, texts[3][0], "de", "s1", 1), (101, texts[4][0] + " more.", "en", "s2", 1), (102, draw("en", 20) + " " + item + " " + draw("en", 20), "en", "s0", 1), (103, "1234 -- 77", "en", "s3", 1), (104, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    every = {r[0] for r in rows}
    assert ids[0] == every - {103, 104}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] - {102}
    assert ids[3] <= ids[2]
    packed = corpus_pipeline.run(spark, folder)
    encode, _ = packing.encoder(packing.VOCABULARY)
    text = {r[0]: r[1] for r in rows}
    back = packing.unpack(packed).collect()
    assert {r["doc_id"] for r in back} == ids[3]
    assert all(bytes(r["ids"])[:-2] == encode(text[r["doc_id"]]) for r in back)
    assert sum(len(r["ids"]) for r in back) // 2 == sum(r["n_tokens"] for r in packed.collect())
    assert np.all([len(r["ids"]) == 4096 for r in packed.collect()])


def test_language_rejects(spark):
    rng = random.Random(6)
    stems = {"en": "the of and ing tion ent her".split(), "de": "der die und ung keit sch ein".split(), "xx": "kaa vuo yll jok mik saa hyv".split(), "ru": "при ств ени ова тел ого ние".split()}
    draw = lambda k, n: " ".join("".join(rng.choices(stems[k], k=rng.randint(1, 3))) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    good = [(draw(k, n), k) for k in ("en", "de") for n in [60, 200] * 20 + [1, 2, 4, 8, 15]]
    tags = "".join(f'<div class="c{i}"><a href="x{i}.html"><img src="p.jpg" width="{i}"></a></div><br/>' for i in range(40))
    bad = [(noise(n), k) for n in (40, 100, 400) for k in ("en", None)] + [(draw(k, n), None) for k in ("xx", "ru") for n in (60, 300)] + [(tags, None)]
    rows = [(i, t, k) for i, (t, k) in enumerate(good)] + [(1000 + i, t, k) for i, (t, k) in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, df, "").collect()} == set(range(len(good)))


def test_columns_and_odd_rows_come_through(spark, tmp_path):
    """Columns with names that the operators use keep their values; nulls, empties, repeats and no rows at all are fine."""
    rng = random.Random(7)
    draw = lambda n: " ".join(rng.choice("the of and ing tion ent her".split()) + str(i % 7) for i in range(n))
    names = ["score", "lang_pred", "affinity", "size", "target", "copies", "taken", "source_size", "key", "hot", "turn", "parts", "salt", "pattern", "hash", "turns", "win", "bands", "first", "a"]
    rows = [(i, draw(60 + i), "en", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(24)]
    rows += [(50, None, None, None, *names), (51, "", "en", "s0", *names), (None, draw(70), "en", None, *names), rows[3]]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    folder = str(tmp_path)
    spark.createDataFrame([(1, "nowhere to be seen at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    whole = {(r[0], r[1]): tuple(r) for r in rows}
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == ["doc_id", "text", "lang", "source", *names]
            docs.write.parquet(f"{folder}/{name}{len(some)}")
            docs = spark.read.parquet(f"{folder}/{name}{len(some)}")
            got = docs.collect()
            assert all(tuple(r) == whole[r["doc_id"], r["text"]] for r in got)
            if name != "mixing":
                assert len(got) == (25 if some and name != "language" else 26 if some else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).isEmpty() == (not some)
