"""The Merkle manifest, address rules and whitening against plain versions, on odd input: nulls, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lernspur.llm import merkle, queries, url_rules, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank long, n int, item string, block int, tree string, root string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climbed(leaves):
    """The top of a list of digests, and the steps (before, after) of each."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for way, i in zip(ways, at, strict=True):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            way.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level, at = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return (level or [None])[0], ways


def plain_manifest(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    by, out = {}, []
    for doc_id, source, lang, n_chars, text in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        leaf = coded(doc_id, source, lang, n_chars, text)
        by.setdefault(lang, []).append((first(doc_id), leaf, coded(doc_id, source, lang, n_chars, lower(text)) if hit else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops = {x: climbed([leaf for _, leaf, _ in sorted(by[x])]) for x in langs}
    root, up = climbed([tops[x][0] for x in langs])
    for x, above in zip(langs, up, strict=True):
        for (doc, leaf, folded), way in zip(sorted(by[x]), tops[x][1], strict=True):
            for a, b in (way := [*way, *above]):
                folded = h(a, folded, b)
            out.append((doc[1] if doc[0] else None, leaf, tops[x][0], root, h(*(a + b for a, b in way)), folded, folded == root))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 9, 65, 700])
def test_merkle_manifest(spark, n):
    r = random.Random(n)
    rows = [(i * 7 % 911, r.choice(["a", "é", None]), r.choice(["en", "en", "en", "fr", "", None]), r.choice([i, None]), r.choice([f"Text {i} ÄÖ\nB", "", None, "same"])) for i in range(n)]
    if n == 700:
        rows += [rows[3]] * 600 + [(None, None, None, None, None)] * 3 + [(5, "x", "zz", 1, "alone"), (None, "b", "en", 0, "Big" * 50_000)]
    df = spark.createDataFrame([(*x, 1, 2, "i", 3, "t", "r", "p") for x in rows], DOCS)
    found = merkle.manifest(df, {"tampered": merkle.tampered_leaf()}, merkle.MerkleConfig(levels=2, rows_per_slice=100))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((x[:-1] for x in plain_manifest(rows)), key=key)


def test_merkle_blocks_and_slices_do_not_matter(spark):
    df = spark.createDataFrame([(i, "s", "en", i, f"T{i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    roots = {merkle.manifest(df.repartition(k), config=merkle.MerkleConfig(levels, slices)).select("root").distinct().first()[0] for k, levels, slices in ((1, 1, 10), (5, 3, 50_000))}
    assert roots == {plain_manifest([tuple(x) for x in df.collect()])[0][3]}


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = lower(rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(r.split(".")) if r else 0, len(p), v, r + p) for v, r, p in rules if (r == "" or host == r or host.endswith("." + r)) and path.startswith(p)]
    return (host, path, None, default) if not fits else (host, path, max(fits)[3], max(fits)[2])


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com/en", "http://example.com/en/", "http://a.b.example.com/en/x?y#z", "http://www.example.com/en/a/b",
    "http://x.www.example.com/en/", "http://www.example.com/fr/", "http://notexample.com/en/", "http://m.example.net/es/1", "http://net/fr/", "http://example.net/es?x", "http://xnet/es/", "http://example.org/en/", "http://example.com:80/en/",
    "http://u@example.com/en/", "a://b://c.com/", "http://example.com?q=/en/", "http://example.com\n/en/", "http://.com/en/", "http://com./en/", "http://ÀB.example.com/en/é", "http://" + "a." * 5000 + "com/en/", "http://q.net/" + "es/" * 50_000,
]
MORE = (*url_rules.RULES, ("block", "q.org", ""), ("allow", "q.org", "/a"), ("block", "q.org", "/ab/c"), ("allow", "q.org", "/ab/cd"), ("allow", "twice.org", "/"), ("block", "twice.org", "/"), ("block", "", "/everywhere/"))


def test_trie_equals_plain_and_join(spark):
    r = random.Random(3)
    made = [f"http://{'.'.join(r.choice(['a', 'q', 'www', 'twice', 'example', 'org', 'net', 'com']) for _ in range(r.randint(1, 4)))}{r.choice(['', '/', '/a', '/ab', '/ab/', '/ab/c', '/ab/cd', '/abc', '/everywhere/x', '/en/', '/es/', '/fr/x'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "host", "p", "r", "v", "j") for i, u in enumerate([*URLS, *made, URLS[6], URLS[6]])], "page_id long, url string, host string, path string, rule string, verdict string, judged string")
    rules = url_rules.rule_table(spark, [*MORE, ("block", None, "/"), (None, "com", "/"), ("maybe", "com", "/"), ("block", "com", "no slash"), ("allow", "Q.ORG", None)])
    known = [*MORE, ("allow", "q.org", "")]
    want = [(i, *plain_verdict(u, known)) for i, u in enumerate([*URLS, *made, URLS[6], URLS[6]])]
    for config in (url_rules.UrlConfig(), url_rules.UrlConfig(most_chars=10)):
        got = url_rules.judge(pages, rules, config).select("row.page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
        assert [tuple(x) for x in got] == want
    kept = url_rules.keep_allowed(pages, rules)
    assert kept.columns == pages.columns and kept.count() == sum(x[-1] == "allow" for x in want)
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {x.verdict for x in url_rules.judge(pages, rules.limit(0), url_rules.UrlConfig("block")).collect()} == {"block"}
    with pytest.raises(ValueError):
        url_rules.judge(pages, rules, url_rules.UrlConfig("maybe"))


def plain_whitening(vectors, k=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x], centred @ vectors / np.sqrt(values), values / (centred**2).sum() * n


def test_whitening_query_equals_plain(spark, sf_dir):
    table = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    deviations, white, explained = plain_whitening(list(table.values()))
    got = {}
    for r in queries.op13_feast_whitening(spark, sf_dir).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == table.keys() and all(set(x) == set(range(1, 9)) for x in got.values())
    turned = np.array([[got[i][c].whitened for c in range(1, 9)] for i in table])
    signs = np.sign((turned * white).sum(axis=0))
    np.testing.assert_allclose(turned * signs, white, atol=1e-9)
    for i, want in zip(table, deviations, strict=True):
        assert got[i][1].deviation == want and got[i][1].n == len(table) and got[i][1].identity_error < 1e-10
    np.testing.assert_allclose([got[0][c].explained for c in range(1, 9)], explained, rtol=1e-10)


def test_whitening_odd_input(spark):
    r = np.random.default_rng(1)
    good = [[float(x) for x in v] for v in r.normal(size=(40, 5)) * [9, 3, 3, 1, 0]]
    bad = [None, [], [1.0, 2.0], [1.0, None, 2.0, 3.0, 4.0], [1.0, math.nan, 2.0, 3.0, 4.0], [math.inf, 0.0, 2.0, 3.0, 4.0], [1e300, 0.0, 2.0, 3.0, 4.0]]
    rows = [(i, v, "n", "w", 1, "x") for i, v in enumerate([*good, *bad])] + [(0, good[0], None, None, None, None)] * 3 + [(None, good[1], None, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whitened string, row int, `a b.c` string")
    got = whitening.whiten(df).select("row.vec_id", "row.`a b.c`", "n", "deviation", "whitened", "explained", "identity_error").collect()
    kept = [*good, *[good[0]] * 3, good[1]]
    deviations, white, explained = plain_whitening(kept, 4)  # one direction is constant
    assert len(got) == len(kept) and {x.n for x in got} == {len(kept)} and {len(x.whitened) for x in got} == {4}
    assert sorted(int(x.deviation) for x in got) == sorted(deviations)
    np.testing.assert_allclose(got[0].explained, explained, rtol=1e-10)
    assert got[0].identity_error < 1e-9
    np.testing.assert_allclose(sorted(abs(x.whitened[0]) for x in got), sorted(np.abs(white[:, 0])), atol=1e-9)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id in (40, 43, 44)")).count() == 0
    alone = whitening.whiten(df.where("vec_id = 5")).first()
    assert (alone.n, alone.deviation, alone.whitened, alone.explained) == (1, 0, [], [])


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [7, 7, 7, 1, 1, 1], [3] * 6, [9, 1e-3, 1e-9, 0], [100, *[1 + 1e-7 * i for i in range(30)]], [2.0], [1e12, 5, 4.9999, 4.9998, 1, 1, 1, 1, 1, 0.5]])
def test_feast_finds_all_leading_pairs(values):
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))
    v = q @ np.diag(values).astype(float) @ q.T
    v = (v + v.T) / 2
    for k in (1, 3, 8):
        found, rows = whitening.leading_components(v, whitening.WhitenConfig(components=k))
        want = [x for x in sorted(values, reverse=True) if x > 1e-14 * max(values)][:k]
        np.testing.assert_allclose(found, want, atol=1e-12 * max(values))
        np.testing.assert_allclose(rows @ rows.T, np.eye(len(want)), atol=1e-9)
        np.testing.assert_allclose(v @ rows.T, rows.T * found, atol=1e-11 * max(values))


def test_counts_of_inertia_and_exact_sums():
    v = np.cov(np.random.default_rng(2).normal(size=(50, 20)).T)
    form = whitening.tridiagonal(v)
    want = np.linalg.eigvalsh(v)
    assert [whitening.count_above(form, s) for s in np.linspace(-1, 5, 40)] == [int((want > s).sum()) for s in np.linspace(-1, 5, 40)]
    x = np.array([[1 << 50, -(1 << 50)], [3, 4]], dtype=np.int64)
    n, sums = 10**9, [(1 << 40) * 10**9 + 7, 5]
    assert whitening._deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    batch = pa.RecordBatch.from_pylist([{"v": [0.5, -0.001]}])
    assert whitening._numbers(batch, 2, whitening.WhitenConfig()).tolist() == [[100_512, 99_998]]
