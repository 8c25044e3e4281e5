"""Language identification and the whole pipeline against plain versions, on odd input."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lernspur.llm import langid, tokens
from lernspur.llm.oracles import mix_sql, quality_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = 0xFFFFFFFF


def buckets(text, config):
    """Hashed grams of one to three characters, place by place."""
    out = []
    for n in range(1, config.max_chars + 1):
        for i in range(len(text) - n + 1):
            mixed = 0
            for c in text[i : i + n]:
                mixed = (mixed * 0x9E3779B1 + ord(c) + 1) & MASK
            out.append((((mixed ^ (mixed >> 15)) * (0x85EBCA6B + 2 * n)) & MASK) >> (32 - config.bucket_bits))
    return out


def plain_languages(rows, config):
    """(lang_pred, score) of (doc_id, text, lang) rows, by the textbook."""
    counts, docs = {}, collections.Counter()
    for doc, text, lang in rows:
        held = doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2
        if not held and lang is not None and text is not None:
            counts.setdefault(lang, np.full(1 << config.bucket_bits, config.smoothing))
            np.add.at(counts[lang], buckets(text.lower(), config), 1)
            docs[lang] += 1
    names = sorted(counts)
    logs = {k: np.log(counts[k] / counts[k].sum()) for k in names}
    usual = {k: float((np.exp(logs[k]) * logs[k]).sum()) for k in names}
    out = []
    for _, text, _ in rows:
        if not names or not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        grams = buckets(text.lower(), config)
        sums = {k: float(logs[k][grams].sum()) for k in names}
        likely = {k: sums[k] + math.log(docs[k] / sum(docs.values())) for k in names}
        best = max(names, key=lambda k: likely[k])
        posterior = 1 / sum(math.exp(likely[k] - likely[best]) for k in names)
        out.append((best, posterior * math.exp(min(0.0, sums[best] / len(grams) - usual[best]))))
    return out


def test_languages_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "words of no id", "en"), (7001, "", "en"), (7002, None, "fr"), (7003, "... 12", "de"), (7004, "ñ", None), (7005, "long text " * 30_000, "en"), (7006, "Ünï 漢字", "xx")], "doc_id long, text string, lang string")
    both = docs.unionByName(odd).withColumns({"row": langid.F.lit("r"), "held_out": langid.F.lit(1), "lang_pred": langid.F.lit("q"), "score": langid.F.lit(0.5)})
    got = langid.identify(both)
    rows = got.select("row.doc_id", "row.text", "row.lang", "lang_pred", "score").collect()
    want = plain_languages([r[:3] for r in rows], langid.LangConfig())
    assert len(rows) == both.count()
    for r, (lang, score) in zip(rows, want, strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 2e-3


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(df, langid.LangConfig(most_languages=5))


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(a), WORD.findall(b)))
    return len(x & y) / len(x | y)


def odd_documents(spark, sf_dir):
    """The table of the smallest size, with nulls in every column, repeated rows, copies, empty and long texts, an unknown language and clashing extra columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs.where("size(split(text, ' ')) >= 60").orderBy("doc_id").limit(3).collect()
    r = random.Random(2)
    foreign = " ".join("".join(r.choice("дкйъэфцч") for _ in range(r.randint(2, 9))) for _ in range(200))
    long_text = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(30_000))
    more = [(None, kept[0].text, "en", "src1", 3), (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, foreign, None, "src2", 5), (9004, long_text, "en", "src3", None)]
    more += [(9010 + i, kept[1].text + f" tail{i}", kept[1].lang, "src4", 9) for i in range(4)] + [(kept[2].doc_id, kept[2].text, kept[2].lang, kept[2].source, kept[2].n_chars)] * 2
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"row": langid.F.lit("r"), "size": langid.F.lit(1), "node": langid.F.lit("n"), "key": langid.F.lit(None).cast("double")})


def sql_rows(query, docs):
    con = duckdb.connect()
    con.register("given", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    cursor = con.execute(query)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]


def test_pipeline_stages_on_odd_documents(spark, sf_dir):
    docs = odd_documents(spark, sf_dir)
    columns, texts = docs.columns, lambda df: collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)
    written = lambda df, name: corpus_pipeline.materialize(df, name)

    good = written(stages["quality rules"](spark, docs, sf_dir), "good")
    plain = docs.select("doc_id", "text", "lang", "source")
    kept = collections.Counter(r["doc_id"] for r in sql_rows(quality_sql(), plain.withColumn("doc_id", langid.F.col("doc_id").cast("double"))) if r["kept"])
    assert good.columns == columns
    assert {int(k): n for k, n in kept.items() if k == k and k is not None} == {k: n for k, n in collections.Counter(r.doc_id for r in good.collect()).items() if k is not None}

    known = written(stages["language id"](spark, good, sf_dir), "known")
    rows = [(r.doc_id, r.text, r.lang) for r in good.collect()]
    want = collections.Counter((d, t) for (d, t, _), (lang, score) in zip(rows, plain_languages(rows, langid.LangConfig()), strict=True) if lang != "und" and score >= 0.3)
    assert known.columns == columns and texts(known) == want

    single = written(stages["near dedup"](spark, known, sf_dir), "single")
    pairs = sorted(texts(known), key=lambda x: (x[0] is None, x[0] or 0))
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if jaccard(pairs[i][1], pairs[j][1]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert single.columns == columns and texts(single) == collections.Counter(pairs[i] for i in range(len(pairs)) if find(i) == i)

    mixed = written(stages["mix sources"](spark, single, sf_dir), "mixed")
    taken = collections.Counter()
    for r in sql_rows(mix_sql(), single.select("doc_id", "text", "source")):
        taken[r["doc_id"]] += r["taken"]
    found = collections.Counter()
    whole = {r.doc_id: r.text for r in single.collect()}
    for r in mixed.select("doc_id", "text").collect():
        found[r.doc_id] += len(WORD.findall(r.text))
        assert whole[r.doc_id].startswith(r.text)
    assert mixed.columns == columns and found == +taken

    library, ids = Tokenizer.from_file(tokens.default_tokenizer()), collections.Counter()
    for r in mixed.select("doc_id", "text").collect():
        x = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        ids.update((r.doc_id, s, zlib.crc32(x[s : s + 1024].tobytes()), len(x)) for s in range(0, len(x), 1024))
    packed = stages["pack windows"](spark, mixed, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in packed) == ids


def test_pipeline_of_nothing(spark, sf_dir):
    docs = odd_documents(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "none")
    assert docs.count() == 0
