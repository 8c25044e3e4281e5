"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lernspur.llm.licenses import COPYRIGHT_LINE, KNOWN, SPELLINGS, WHOLE_TEXTS
from lernspur.llm.mixing import MixConfig
from lernspur.llm.quality import COUNTED, METRICS, QualityConfig
from lernspur.llm.url_rules import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mix_sql(config: MixConfig = MixConfig()) -> str:
    n = len(config.weights)
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(n, " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(config.weights)))
    return rf"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
               len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
        FROM documents),
    keyed AS (
        SELECT doc_id, source, size,
               -ln((CAST('0x' || substr(md5('{config.seed}-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
               / CASE WHEN size > 0 THEN size::DOUBLE / (size + 4 * n_symbols)::DOUBLE ELSE 1.0 END AS key
        FROM sized),
    per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
    weighed AS (SELECT source, source_size, {weight} AS weight, {config.max_epochs} * source_size AS full_size FROM per),
    levels AS (
        SELECT *, row_number() OVER o AS place,
               ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
               / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
        FROM weighed WINDOW o AS (ORDER BY full_size::DOUBLE / weight, source NULLS LAST)),
    fair AS (SELECT arg_min(level, place) AS fair FROM levels WHERE full_size > level * weight),
    targets AS (SELECT source, source_size, coalesce(least(full_size::DOUBLE, fair * weight), full_size::DOUBLE) AS target FROM levels, fair),
    placed AS (
        SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
               (sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) - k.size)::BIGINT AS before
        FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, source, size, source_size, target,
           (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
    FROM placed"""


def quality_sql(config: QualityConfig = QualityConfig()) -> str:
    cell = "(greatest(length(bin({0})) - 7, 0) * 256 + ({0} >> greatest(length(bin({0})) - 7, 0)))"
    metric = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {cell.format(m)} AS cell FROM passed" for m in METRICS)

    def quartiles(keys: str) -> str:
        at = "min(cell) FILTER (WHERE run * 4 >= docs * {})"
        return f"""SELECT {keys} metric, max(docs)::BIGINT AS docs, (({at.format(1)} % 256) << ({at.format(1)} // 256))::BIGINT AS q1, (((({at.format(3)} % 256) + 1) << ({at.format(3)} // 256)) - 1)::BIGINT AS q3
        FROM (SELECT {keys} metric, cell, sum(n) OVER (PARTITION BY {keys} metric ORDER BY cell ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY {keys} metric) AS docs
              FROM (SELECT {keys} metric, cell, sum(n) AS n FROM cells GROUP BY {keys} metric, cell)) GROUP BY {keys} metric"""

    drawn = lambda n, q, parent: f"(({n} * {q} + {config.prior} * {parent}) // ({n} + {config.prior}))"
    fences = ", ".join(f"max(q3 + {config.reach} * (q3 - q1)) FILTER (WHERE metric = '{m}') AS max_{m}" for m in METRICS)
    over = " OR ".join(f"s.{count} * 1000 > f.max_{m} * s.{of} + {spare * 1000}" for m, (count, of, spare) in COUNTED.items())
    return rf"""
    WITH split AS (
        SELECT row_number() OVER () AS r, doc_id, lang, source, {_WORDS} AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
               len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols
        FROM documents),
    windows AS (
        SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS times
        FROM (SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM split))),
    repeated AS (
        SELECT r, sum(covered) AS n FROM (
            SELECT r, least(3, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 3)) AS covered FROM windows WHERE times > 1) GROUP BY r),
    counted AS (
        SELECT split.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM split LEFT JOIN repeated ON split.r = repeated.r),
    scored AS (
        SELECT *, n_words < {config.min_words} OR n_repeat_words * 100 > n_words * {config.max_repeat_percent} AS base_failed,
               CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_len,
               CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
               CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
               CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_words
        FROM counted),
    passed AS (SELECT * FROM scored WHERE NOT base_failed),
    cells AS (SELECT lang, source, metric, cell, count(*) AS n FROM ({metric}) GROUP BY ALL),
    g AS ({quartiles('lang, source,')}),
    l AS ({quartiles('lang,')}),
    e AS ({quartiles('')}),
    ld AS (SELECT l.lang, l.metric, {drawn('l.docs', 'l.q1', 'e.q1')} AS q1, {drawn('l.docs', 'l.q3', 'e.q3')} AS q3 FROM l JOIN e USING (metric)),
    used AS (
        SELECT g.lang, g.source, g.metric, {drawn('g.docs', 'g.q1', 'ld.q1')} AS q1, {drawn('g.docs', 'g.q3', 'ld.q3')} AS q3
        FROM g JOIN ld ON g.lang IS NOT DISTINCT FROM ld.lang AND g.metric = ld.metric),
    f AS (
        SELECT lang, source, {fences}, max(q1 - {config.reach} * (q3 - q1)) FILTER (WHERE metric = 'word_len') AS min_word_len
        FROM used GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(s.word_len > f.max_word_len OR s.word_len < f.min_word_len OR {over}, false) AS kept
    FROM scored s LEFT JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source"""


def license_sql() -> str:
    """Word lists and a map of spellings, where the query replaces inside the text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    single = [(a, b) for a, b in SPELLINGS if " " not in a]
    spelled = f"MAP {{{', '.join(f'{quoted(a)}: {quoted(b)}' for a, b in single)}}}"

    def form(text: str) -> str:
        words = rf"string_split_regex(regexp_replace(lower(coalesce({text}, '')), {quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g'), '[^\p{{L}}\p{{N}}]+')"
        out = f"' ' || array_to_string(list_transform(list_filter({words}, lambda w: w <> ''), lambda w: coalesce({spelled}[w], w)), '  ') || ' '"
        for said, meant in SPELLINGS:
            if " " in said:
                out = f"replace({out}, ' {said.replace(' ', '  ')} ', ' {meant.replace(' ', '  ')} ')"
        return f"trim(replace({out}, '  ', ' '))"

    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    whole = ", ".join(f"({quoted(h)}, {quoted(i)})" for i, h in WHOLE_TEXTS)
    return f"""
    WITH known AS (
        SELECT h, min(license_id) AS license_id
        FROM (SELECT sha256({form('body')}) AS h, license_id FROM (VALUES {rows}) AS v(license_id, body) UNION ALL SELECT * FROM (VALUES {whole}) AS w(h, license_id)) GROUP BY 1)
    SELECT doc_id, canonical_sha256, license_id
    FROM (SELECT doc_id, sha256({form('text')}) AS canonical_sha256 FROM documents) d LEFT JOIN known ON d.canonical_sha256 = known.h"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a string of digits and signs, bit by bit."""
    bits = f"list_transform(range(8 * length({text})), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr({text}, i // 8 + 1, 1))::BIGINT ELSE 0 END)"
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: {step}), 4294967295::BIGINT)"


def merkle_sql(levels: int = 9, top_levels: int = 4) -> str:
    """The tree level by level over all nodes, for up to 8 ** levels leaves of a language; each leaf's way up is a join a level."""
    fields = [("doc_id", "CAST(doc_id AS VARCHAR)"), ("source", "source"), ("lang", "lang"), ("n_chars", "CAST(n_chars AS VARCHAR)")]
    code = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    lead = " || ".join(code(v) for _, v in fields)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def climb(name: str, key: str, first: str, n: int) -> str:
        out = [f"{name}0 AS ({first})"]
        for i in range(n):
            out.append(f"""{name}{i + 1} AS (
        SELECT {key}, r // 8 AS r, CASE WHEN max(m) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE max(h) END AS h, (max(m) + 7) // 8 AS m FROM {name}{i} GROUP BY {key}, r // 8)""")
            out.append(f"""{name}s{i} AS (
        SELECT a.{key}, a.r, CASE WHEN max(a.m) > 1 THEN coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (WHERE b.r < a.r), '') END AS before,
               CASE WHEN max(a.m) > 1 THEN coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (WHERE b.r > a.r), '') END AS after
        FROM {name}{i} a JOIN {name}{i} b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.r // 8 = b.r // 8 GROUP BY a.{key}, a.r)""")
        return ",\n    ".join(out)

    up = lambda was, name, at, on, keep: f"""(SELECT {keep}, w.proof || coalesce(s.before || s.after, '') AS proof, CASE WHEN s.before IS NULL THEN w.h ELSE sha256(s.before || w.h || s.after) END AS h
        FROM {was} w JOIN {name} s ON {on} AND s.r = {at})"""  # noqa: E731
    ways = []
    for i in range(levels):
        ways.append(f"w{i + 1} AS {up(f'w{i}', f'ls{i}', f'w.r // {8**i}', 'w.lang IS NOT DISTINCT FROM s.lang', 'w.doc_id, w.lang, w.r, w.leaf, w.k')}")
    for i in range(top_levels):
        ways.append(f"w{levels + i + 1} AS {up(f'w{levels + i}', f'ts{i}', f'w.k // {8**i}', 's.one = 1', 'w.doc_id, w.lang, w.r, w.leaf, w.k')}")
    return f"""
    WITH leaves AS (
        SELECT doc_id, lang, sha256({lead} || {code('text')}) AS leaf,
               CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({lead} || {code(lower)}) END AS tampered
        FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS m, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k
        FROM leaves),
    {climb('l', 'lang', 'SELECT lang, r, leaf AS h, m FROM placed', levels)},
    {climb('t', 'one', f'SELECT 1 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, h, count(*) OVER () AS m FROM l{levels}', top_levels)},
    w0 AS (SELECT doc_id, lang, r, leaf, k, '' AS proof, coalesce(tampered, leaf) AS h FROM placed),
    {", ".join(ways)}
    SELECT w.doc_id, w.leaf, l{levels}.h AS subroot, t{top_levels}.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t{top_levels}.h AS verified
    FROM w{levels + top_levels} w JOIN l{levels} ON w.lang IS NOT DISTINCT FROM l{levels}.lang CROSS JOIN t{top_levels}"""


def url_sql() -> str:
    """The rules one after the other, the longest first."""
    longest = sorted(RULES, key=lambda r: (-len(r[1].split(".")), -len(r[2])))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in longest]
    rule, verdict = (" ".join(f"WHEN {f} THEN '{x[i]}'" for f, *x in fits) for i in (0, 1))
    return f"""
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict
    FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)"""


ORACLES: dict[str, str] = {
    "op2_source_mix": mix_sql(),
    "op3_adaptive_quality": quality_sql(),
    "op9_license_digests": license_sql(),
    "op11_merkle_manifest": merkle_sql(),
    "op12_url_rules": url_sql(),
}
