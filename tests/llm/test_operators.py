"""Each operator on odd input: nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns, empty tables."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lernspur.llm import fingerprint, html_blocks, langid, licenses, mixing, neardup, packing, quality, token_files, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(300, 1)
TEXTS = [
    BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " tail end", " ".join(BASE.split()[:-4] + ["x", "y", "z", "w"]),
    None, "", " \n\t ", "one", "two words", "###", "ñandú über 漢字 text", prose(120, 2), prose(120, 3), "the same line\n" * 40, prose(60_000, 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, node string, key double, slice int, w string, h int, next string, length long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], None, "r", 1, "n", 0.5, 2, "w", 3, "x", 4) for i, t in enumerate(TEXTS)]
    rows += [rows[12], rows[12], (None, "no id here", "en", "a", None, *rows[0][5:]), (3, "an id again", "en", "a", None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def word_counts(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for i, t in enumerate(tri):
        seen.setdefault(t, []).append(i)
    covered = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    got = quality.score_quality(odd).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        assert tuple(r[2:7]) == word_counts(r.text)
        assert r.base_failed == (r.n_words < 50 or r.n_repeat_words * 100 > r.n_words * 50)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 12").count() == 3
    assert quality.keep_good(none).count() == 0


def test_quality_fences_follow_the_group(spark):
    """Two groups with unlike texts get unlike fences: what is common in one is rejected in the other."""
    r = random.Random(6)

    def text(words, symbols):
        w = [prose(1, r.random())[:4] * words for _ in range(100)]
        for _ in range(symbols):
            w.insert(r.randrange(len(w)), "|")
        return " ".join(w)

    rows = [(i, text(1, r.randint(0, 2)), "en", "plain") for i in range(300)] + [(1000 + i, text(2, r.randint(20, 60)), "en", "tables") for i in range(300)]
    rows += [(500, text(1, 200), "en", "plain"), (501, text(4, 0), "en", "plain"), (1500, text(2, 70), "en", "tables"), (1501, text(2, 900), "en", "tables"), (2000, text(2, 40), "en", "tables")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert {1500, 2000} <= kept and not {500, 501, 1501} & kept
    assert len(kept) > 0.97 * len(rows)
    # whole numbers in, whole numbers out: quartiles of all are within a cell of the true ones
    cells = spark.range(2000).selectExpr("id * id as v").select("v", quality.sketch_cell(quality.F.col("v")).alias("c")).select("v", *quality.cell_bounds(quality.F.col("c"))).toDF("v", "low", "high").collect()
    assert all(x.low <= x.v <= x.high <= max(x.low, x.low * 65 // 64) for x in cells)


def test_quality_keeps_equal_documents(spark):
    for n in (1, 3, 400):
        df = spark.createDataFrame([(i, prose(120, 2), "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string")
        assert quality.keep_good(df).count() == n


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).select("row.doc_id", "row.source", "size", "source_size", "target", "epochs", "part", "taken").collect()
    assert len(got) == odd.count()
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        s = per.setdefault(r.source, [r.target, 0, r.source_size])
        s[1] += r.taken
    assert abs(sum(t for t, _, _ in per.values()) - total) < 1e-6 * total
    for target, taken, _ in per.values():
        assert abs(target - taken) <= 1
    again = mixing.mix(odd).select("row.doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(odd).select("row.doc_id", "taken").collect())
    mixed = mixing.take_mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.take_mix(none).count() == 0


def test_mixing_caps_small_sources(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(i + 10, "w " * 10, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r.source: r.target for r in mixing.source_targets(df.selectExpr("source", "10L as size")).collect()}
    assert targets == {"a": 90.0, "b": 2940.0}


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(spark, odd, none):
    got = fingerprint.fingerprint_pairs(odd).select("*", fingerprint.likeness(fingerprint.F.col("fingerprint"), fingerprint.F.col("edited_fingerprint")).alias("near_edited"), fingerprint.likeness(fingerprint.F.col("fingerprint"), fingerprint.F.col("next_fingerprint")).alias("near_next")).collect()
    assert len(got) == odd.count()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = []
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((r.doc_id, len(text), edited, jaccard(text, edited), jaccard(text, after)))
    key = lambda r: (str(r[0]), r[1], r[2])
    found = sorted(((r.doc_id, r.n_chars, r.edited, r.near_edited, r.near_next) for r in got), key=key)
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3]
        assert abs(a[3] - b[3]) < 0.25 and abs(a[4] - b[4]) < 0.25
    by_text = {}
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), rows, strict=True):
        del t
        by_text.setdefault(r.fingerprint, 0)
    assert fingerprint.fingerprint_pairs(none).count() == 0
    alone = fingerprint.fingerprint_pairs(odd.where("doc_id = 8")).first()
    assert alone.fingerprint == alone.next_fingerprint


def test_fingerprint_error_and_densification(spark):
    base = prose(400, 9).split()
    rows = [(i, " ".join(base), " ".join(base[: 400 - 40 * i])) for i in range(9)] + [(20, " ".join(base[:12]), " ".join(base[:10]))]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    F = fingerprint.F
    two = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, F.col("a"), "fa"), F.col("b"), "fb")
    for r in two.select("a", "b", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("s")).collect():
        assert abs(r.s - jaccard(r.a, r.b)) < 0.17


def test_near_duplicates(spark, odd, none):
    got = neardup.near_duplicates(odd).select("row.doc_id", "row.text", "class_id", "class_docs").collect()
    assert len(got) == odd.count()
    texts = sorted({(r.text or "") for r in got})
    group = {t: t if WORD.search(t) else "" for t in texts}
    for a in texts:
        for b in texts:
            if a < b and shingles(a) and shingles(b) and jaccard(a, b) >= 0.8:
                x, y = group[a], group[b]
                group = {k: x if v == y else v for k, v in group.items()}
    ids = {}
    for r in got:
        if r.doc_id is not None:
            g = group[r.text or ""]
            ids[g] = min(ids.get(g, r.doc_id), r.doc_id)
    assert all(r.class_id == ids.get(group[r.text or ""]) for r in got)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(group.values()))
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicate_chains_and_large_groups(spark):
    base = prose(200, 11).split()
    rows = []
    for i in range(120):
        r = random.Random(i)
        w = list(base)
        for _ in range(i % 12):
            w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(50)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "class_id").collect()}
    texts, parent = dict(rows), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {i: find(i) for i in texts}


def test_near_duplicates_of_repeated_texts(spark):
    rows = []
    for i in range(40):
        text = prose(150, 500 + i)
        rows += [(10 * i + k - 1, "\n".join([text] * k)) for k in (1, 2, 3, 4)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "class_id", "class_docs").collect()
    assert all((r.class_id, r.class_docs) == (r.doc_id // 10 * 10, 4) for r in got) and len(got) == 160


def test_dart_signatures_estimate_weighted_jaccard():
    config = neardup.NearDupConfig(bands=200, rows=5)
    r = np.random.default_rng(1)
    e = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = {x: 1.0 + (i % 3) for i, x in enumerate(e[:200])}, {x: 1.0 + (i % 2) for i, x in enumerate(e[60:260])}
    docs = np.repeat([0, 1], [len(a), len(b)])
    signature = neardup.dart_signatures(np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), docs, 2, config)
    keys = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs((signature[0] == signature[1]).mean() - want) < 0.06


def test_language_id(spark, none):
    def text(language, seed):
        r = random.Random(seed)
        letters = {"xx": "aeioklmnp", "yy": "tzrsguvwb", "zz": "日本語文字"}[language]
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(30))

    rows = [(i, text(("xx", "yy", "zz")[i % 3], i), ("xx", "yy", "zz")[i % 3]) for i in range(120)]
    rows += [(200, None, "xx"), (201, "", "yy"), (202, "123 !?", "xx"), (203, text("xx", 7), None), (None, text("yy", 8), None), (5, rows[5][1], "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).select("row.*", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang and r.doc_id != 5:
            assert r.lang_pred == r.lang
    assert sum(r.held_out and r.lang is not None for r in got) > 10
    assert langid.keep_known(df).columns == df.columns and langid.keep_known(df).count() == len(rows) - 3
    assert langid.keep_known(none).count() == 0
    unlabelled = df.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_packing(spark, odd, none):
    library = Tokenizer.from_file(tokens.default_tokenizer())
    got = packing.pack(odd).collect()
    want = collections.Counter()
    for doc, text in odd.select("doc_id", "text").collect():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((doc, s, min(1024, len(ids) - s), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024))
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert sorted({r.sequence_id for r in got}) == list(range(max(r.sequence_id for r in got) + 1))
    sequences, whole = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (pieces[0].padded == 1024 or pieces[0].padded == at)
    assert packing.pack(none).count() == 0


def test_packing_plan_uses_every_length_once():
    r = np.random.default_rng(2)
    for window, size in ((16, 200), (64, 3000)):
        histogram = np.bincount(np.minimum(window, r.geometric(0.08, size)), minlength=window + 1)
        plan, _ = packing.plan_patterns(histogram, packing.PackConfig(window=window))
        used = np.zeros(window + 1, dtype=int)
        for lengths, n in plan:
            assert sum(lengths) <= window
            for m in lengths:
                used[m] += n
        assert (used == histogram).all()
        assert (histogram * np.arange(window + 1)).sum() / (window * sum(n for _, n in plan)) > 0.95


def test_packing_fit_is_least_squares():
    """The fit places nearly all of a large histogram, and its residual is that of a plain projected-gradient solution."""
    r = np.random.default_rng(4)
    histogram = np.bincount(r.integers(1, 33, 40_000), minlength=33)
    combos = packing.filling_combinations(32)
    config = packing.PackConfig(window=32, lean=0.0)
    x = packing.fit_repeats(histogram, combos, config)
    a = np.zeros((33, len(combos)))
    for i, c in enumerate(combos):
        for m in c[c > 0]:
            a[m, i] += 1
    y = np.zeros(len(combos))
    step = 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(20_000):
        y = np.maximum(0, y - step * (a.T @ (a @ y - histogram)))
    plain, own = ((a @ v - histogram)[1:] @ (a @ v - histogram)[1:] for v in (y, x))
    assert (x >= 0).all() and own <= plain * 1.01 + 1 and (x > 0).sum() <= 40
    plan, fitted = packing.plan_patterns(np.where(np.arange(33) < 32, histogram, 0), config)
    assert sum(len(lengths) * n for lengths, n in plan[:fitted]) > 0.5 * histogram[:32].sum()


def test_token_files(spark, odd, none):
    got = token_files.token_file_round_trip(odd).collect()
    assert len(got) == odd.count()
    encode = Tokenizer.from_file(tokens.default_tokenizer())
    want = {}
    for r in odd.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append([*encode.encode(r.text or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        want[r.doc_id].remove(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert token_files.token_file_round_trip(none).count() == 0


def test_huffman_codes():
    r = np.random.default_rng(3)
    for n, longest in ((1, 5), (2, 5), (300, 9), (5000, 14)):
        counts = np.maximum(1, (r.pareto(0.6, n) * 10).astype(np.int64))
        lengths = token_files.code_lengths(counts, longest)
        assert lengths.max() <= longest and sum(2.0 ** -int(x) for x in lengths) <= 1
        ids = r.choice(n, 4000, p=counts / counts.sum())
        bounds = np.array([0, 1, 1500, 1500, 4000])
        data, begin, marks = token_files.encode_ids(ids, bounds, lengths, token_files.canonical_codes(lengths), 100)
        checkpoints = np.concatenate([m + 8 * b for m, b in zip(marks, begin[:-1])])
        assert (token_files.decode_ids(data, np.diff(bounds), checkpoints, token_files.decode_table(lengths), 100) == ids).all()


def test_chunked_tokens_equal_whole_text_tokens():
    encode, library = tokens.encoder(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["", None, " ", "\n\n", "a  b\n c\t\td ", "it's  they're", "<|endoftext|> a", "b<|endoftext|><|endoftext|>", "1 2\r\n3", "x" * 300, "a b\u3000 c", " lead", "a\n\nb c", "a \nb", "漢字 und Ünïcode", "a×b÷c ß´ …. «q»"]
    r = random.Random(8)
    parts = [" ", "\n", "\t", "a", "B", "1", ".", "'s", "é", "–", "\u2003", "日", "'", "ll", "x\r", "word", "<|endoftext|>"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)] + [t for t in TEXTS if t]
    for text, ids in zip(texts, encode.encode(pa.array(texts), 2), strict=True):
        assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_other_tokenizers_encode_whole_texts():
    path = tokens.default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k")
    texts = ["Some words, and  more", None, "", "line\nends"]
    library = Tokenizer.from_file(path)
    for text, ids in zip(texts, tokens.encoder(path).encode(pa.array(texts), 2), strict=True):
        assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_licenses(spark, none):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and t.startswith("Permission"))
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ")), (3, mit + " And more."), (4, None), (5, ""), (6, "released under the MIT Licence"), (None, mit), (1, mit)]
    got = licenses.match_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    assert sorted((str(r.doc_id), str(r.license_id)) for r in got) == sorted([("1", "MIT"), ("2", "MIT"), ("3", "None"), ("4", "None"), ("5", "None"), ("6", "MIT"), ("None", "MIT"), ("1", "MIT")])
    assert licenses.match_licenses(none, licenses.known_licenses(spark)).count() == 0


ISC_PUBLISHED = """Copyright (c) 4-digit year, Company or Person's Name

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def test_licenses_wrapped_respelled_and_with_holders(spark):
    """Every known text matches at every line width, in capitals, respelled, and under copyright lines; SQL agrees on all of them."""
    import textwrap

    import duckdb

    from lernspur.llm.oracles import license_sql

    rows, want = [], []
    for name, text in licenses.KNOWN:
        forms = ["\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n")) for width in (20, 43, 72, 100)]
        forms += ["Copyright (c) 2001-2020 Some Holder\n  * Copyright 2020 <b@c.d>\n© Another\r\nAll rights reserved.\n\n" + text, text.upper(), re.sub(r"\b([Ll])icense", r"\1icence", text), text.replace("holder", "owner"), "// " + text.replace("\n", "\n// ")]
        for f in forms:
            rows.append((len(rows), f, "x", "y"))
            want.append(name)
    rows.append((len(rows), ISC_PUBLISHED, "x", "y"))
    want.append("ISC")
    others = ["licence licence licence", "copyright", "Copyright notice only", "(c) You must retain", None, "", "MIT " * 200_000, "licence\u2028copyright 2020\u2028x"]
    rows += [(len(rows) + i, t, "x", "y") for i, t in enumerate(others)]
    want += [None] * len(others)
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string, known_sha256 string")
    got = licenses.match_licenses(df, licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert con.execute(license_sql() + " ORDER BY doc_id").fetchall() == [(r.doc_id, r.canonical_sha256, r.license_id) for r in got]
    plain = spark.createDataFrame([("licence licence licence",)], "t string").select(licenses.canonical(licenses.F.col("t"))).first()[0]
    assert plain == "license license license"
    tied = licenses.match_licenses(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), licenses.known_licenses(spark, (("Z-1", "Same words."), ("A-1", "same WORDS")))).collect()
    assert [r.license_id for r in tied] == ["A-1"]


def test_license_scan_finds_lines_passages_and_full_texts(spark, none):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and t.startswith("Permission"))
    body = "start here " + "words of a long licence text\ncopyright holders may wrap\n" * 300 + "end"
    long_prints = tuple(licenses.license_prints(spark.createDataFrame([("Long", body)], "license_id string, text string")))
    texts = {
        1: "Some prose.\nReleased under the MIT License.\nMore prose.", 2: f"Title\n\nCopyright 2020 A\n{mit}\n\nTail", 3: "One. Licensed under CC BY-NC 4.0. Two, licensed under the\nApache License, Version 2.0.",
        4: "Released under the MITX License.", 5: None, 6: "", 7: mit, 8: "x\n" + body.replace("\n", " ") + "\ny", 9: body[:-1], 10: "This work is licensed under\ncopyright rules.\nReleased under the MIT License",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = licenses.scan_licenses(docs, licenses.known_licenses(spark), long_prints).collect()
    want = {(1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (3, "CC-BY-NC-4.0"), (4, None), (5, None), (6, None), (7, "MIT"), (8, "Long"), (9, None), (10, "MIT")}
    assert len(got) == len(want) and {(r.doc_id, r.license_id) for r in got} == want
    digests = {r.doc_id: r.canonical_sha256 for r in licenses.match_licenses(docs, licenses.known_licenses(spark)).collect()}
    assert all(digests[r.doc_id] == r.canonical_sha256 for r in got)
    assert {i.split("-")[0] for i, *_ in licenses.FULL_TEXTS} == {"Apache", "CC0", "GPL", "LGPL", "MPL"}
    assert licenses.scan_licenses(none, licenses.known_licenses(spark)).count() == 0


def test_license_scan_equals_search_in_the_documents(spark, sf_dir):
    notes = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3."}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).where("license_id IS NOT NULL").collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in notes.items() if t in (r.text or "")}
    assert got == want and want


PAGE = "<html lang=en><head><title>A &amp; B</title></head><body><nav><a href='/x'>Menu</a></nav><article><h1>Head</h1><p>Some text of the story, told in a row of words.</p></article><!-- no --><script>bad()</script></body>"


def test_warc(spark):
    rows = [(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (3, "http://b/", "", None), (3, "http://b/", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    got = warc.derivatives(warc.responses_from_pages(pages)).collect()
    assert len(got) == 8
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert one["conversion"].block == "Menu\nHead\nSome text of the story, told in a row of words."
    assert "title: A & B" in one["metadata"].block and "outlink: /x" in one["metadata"].block
    for r in got:
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.refers_to == next(x for x in got if x.page_id == r.page_id).refers_to
    texts = {r.record_type: bytes(r.record).decode() for r in warc.derivatives(warc.responses_from_pages(pages)).where("page_id = 1").withColumn("record", warc.record_bytes()).collect()}
    assert texts["conversion"].startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and f"WARC-Refers-To: {one['conversion'].refers_to}" in texts["conversion"]
    assert warc.derivatives(warc.responses_from_pages(pages.limit(0))).count() == 0


@pytest.fixture(scope="module")
def block_model():
    return html_blocks.train(html_blocks.BlockConfig(train_pages=600, epochs=6))


def test_html_blocks(spark, block_model):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>never <b>closed", 5), (5, "u", "<<<>>> & < a", 5), (1, "u", PAGE, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_blocks.main_text(pages, model=block_model).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["Head\nSome text of the story, told in a row of words."] * 2
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_blocks.main_text(pages.limit(0), model=block_model).count() == 0


def test_html_held_out_accuracy(block_model):
    config, r = html_blocks.BlockConfig(), random.Random(99)
    right = total = 0
    for _ in range(80):
        blocks = html_blocks.leaf_blocks(html_blocks.generated_page(r))
        truth = ["\x01" in t for t, _, _ in blocks]
        clean = [(t.replace("\x01", "").replace("\x02", "").strip() or "x", n, p) for t, n, p in blocks]
        if clean:
            p = html_blocks.label(html_blocks.block_vectors(clean, [0, len(clean)], config), [0, len(clean)], block_model) >= 0.5
            right, total = right + int((p == np.array(truth)).sum()), total + len(clean)
    assert right / total > 0.95


def test_html_gradients():
    config = html_blocks.BlockConfig(path_size=5, word_size=4, hidden=3)
    r = np.random.default_rng(0)
    x, mask = r.normal(size=(4, 2, config.size)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=float)
    weights = tuple(r.normal(0, 0.5, s) for s in ((config.size, 12), (3, 12), (12,)))
    for back in (False, True):
        keep = []
        out = html_blocks._run(x, mask, weights, back, keep)
        pull = r.normal(size=out.shape) * mask[:, :, None]
        grads = html_blocks._back(pull, x, mask, weights, keep)
        for w, g in zip(weights, grads, strict=True):
            at = tuple(0 for _ in w.shape)
            w[at] += 1e-5
            high = (html_blocks._run(x, mask, weights, back) * pull).sum()
            w[at] -= 2e-5
            low = (html_blocks._run(x, mask, weights, back) * pull).sum()
            w[at] += 1e-5
            assert abs((high - low) / 2e-5 - g[at]) < 1e-4
