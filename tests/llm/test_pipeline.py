"""The pipeline's stages, and all of it, on a small folder of tables."""

import hashlib
import random
import re

import numpy as np

import corpus_pipeline
from vellum.llm import bpe


def test_stages(spark, tmp_path):
    g = random.Random(11)
    v = ["".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n=80: " ".join(g.choice(v) for _ in range(n))
    a, b = text(20), text(20)
    docs = [(i, text(), "en", "s", 0) for i in range(120)]
    docs = [(d, t + " vile insult" if d % 6 == 0 else t, k, s, n) for d, t, k, s, n in docs]
    docs += [(200, docs[1][1], "en", "s", 0), (201, docs[2][1] + " more", "en", "s", 0), (202, f"{text()} {a} {text()} {b}", "en", "s", 0), (203, f"{text()} {a}", "en", "s", 0), (204, text() + " password=0123456789abcdefghij", "en", "s", 0), (205, None, None, None, None), (206, "", "en", "s", 0)]
    docs = [(d, t, k, s, None if t is None else len(t)) for d, t, k, s, _ in docs]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 6 == 0)) for d in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, a), (2, b)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {d for d, *_ in docs}
    gone = {"toxicity": {d for d in range(120) if d % 6 == 0}, "near_duplicates": {200, 201, 206}, "decontamination": {202, 203}}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        left -= gone.get(name, set())
        assert {r.doc_id for r in out.select("doc_id").collect()} == left and out.count() == len(left), name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns
        if name == "secrets":
            r = out.where("doc_id = 204").first()
            assert r.text.endswith(" [SECRET]") and r.n_chars == len(r.text)
        df = out
    # what is left, by the base rules' patterns and the tokenizers library
    from tokenizers import Tokenizer

    lib, by = Tokenizer.from_file(bpe.vocabulary_path()), {r.doc_id: r for r in df.collect()}
    for d, t, *_ in docs:
        if d in left:
            ids = np.array(lib.encode(re.sub(r"password=[0-9a-z]{12,}", "[SECRET]", t or ""), add_special_tokens=False).ids, "<u4")
            assert (by[d].n_tokens, by[d].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()) and list(by[d].ids) == ids.tolist()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, docs, schema=COLUMNS, labels=(), items=()):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, []))
    assert got.count() == 0 and "ids_sha256" in got.columns


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    """Null and shared doc_ids, equal rows, equal texts, a very long text, and columns of names that the stages use inside."""
    g = random.Random(21)
    text = lambda n=60: " ".join("".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, item = text(), text(), text(), text(), text(12)
    names = ["bad", "text_hash", "row", "word", "class_id", "ids", "toxic", "kind", "h", "score"]
    schema = COLUMNS + "".join(f", {n} string" for n in names)
    rows = [(None, a), (None, b), (None, f"{text()} {item}"), (1, a), (1, c), (1, c), (2, d), (2, f"{item} {d} {text()}"), (3, None), (None, None), (4, ""), (5, text(20_000)), (6, "password=" + "k1" * 20)]
    folder = tables(spark, tmp_path, [(i, t, None, "s", None if t is None else len(t), *names) for i, t in rows], schema, items=[(9, item), (None, text(9)), (10, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        kept[name] = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(kept["toxicity"]) == len(set(rows))
    assert kept["near_duplicates"] == set(rows) - {(None, a), (None, None), (4, "")}  # equal texts keep their least id, null after all others
    assert kept["decontamination"] == {(i, t) for i, t in kept["near_duplicates"] if item not in (t or "")}
    assert (6, "[SECRET]") in kept["secrets"] and len(kept["secrets"]) == len(kept["decontamination"])
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == len(kept["secrets"]) and max(r.n_tokens for r in out) > 20_000 and {r.n_tokens for r in out if r.doc_id == 3} == {0}
