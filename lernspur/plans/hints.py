"""Hint texts over a stand-in lexicon: every part is a sign whose fields are codes chosen by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.functions import hints as H
from lernspur.plans.views import table

#: field -> codes, chosen by the key's remainder after division by (number, step).
FIELDS = {
    "card_shape": [*H.CARD_HANDSHAPES, "Q", ' "C" ', None],
    "shape": [*H.HANDSHAPES, "zz", "", "NA", " 5 ", None],
    "other": ["5", "b", "a", "NA", "", "qq", None],
    "major": [*H.PLACES, "Head ", "Trunk", "Elsewhere", None],
    "minor": [*H.SPOTS, "Forehead", "Wrist", "NA", "", "Neutral", None],
    "movement": [*H.MOVES, "None", "Static", "Wiggling", "", None],
    "repeated": ["0", "1", "", "None", None],
    "sign_type": ["OneHanded", "SymmetricalOrAlternating", "AsymmetricalDifferentHandshape", "AsymmetricalSameHandshape", "NA", "", None],
    "contact": ["1", "0", "", "None", None],
}
STEPS = dict(zip(FIELDS, (1, 3, 7, 11, 2, 5, 13, 17, 19), strict=True))


def lexicon(s, d):
    at = lambda name, codes: F.get(F.array(*[F.lit(c) for c in codes]), F.floor(F.col("p_partkey") / STEPS[name]).cast("int") % len(codes)).alias(name)
    return table(s, d, "part").select("p_partkey", F.upper("p_name").alias("gloss"), (F.col("p_partkey") % 23 > 0).alias("known"), *[at(n, c) for n, c in FIELDS.items()])


def hints(s, d):
    c = F.col
    card = H.pre_attempt_hint(c("gloss"), c("known"), c("card_shape"), c("major"), c("minor"), c("movement"), c("repeated"), c("sign_type"))
    failure = H.generic_failure_hint(c("known"), c("sign_type"), c("movement"), c("contact"))
    make = H.production_hint(c("gloss"), c("known"), c("shape"), c("other"), c("major"), c("minor"), c("movement"), c("repeated"), c("sign_type"))
    return lexicon(s, d).select("p_partkey", card.alias("card"), failure.alias("failure"), make.alias("make"))


def _q(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _map(names, code):
    return f"MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in names.items())}}}[{code}]"


def _hints_sql():
    fields = ", ".join(f"[{', '.join(map(_q, codes))}][(p_partkey // {STEPS[n]}) % {len(codes)} + 1] AS {n}" for n, codes in FIELDS.items())
    bare = lambda n: f"trim(trim(coalesce({n}, '')), '\"')"
    flat = lambda n: f"trim(coalesce({n}, ''))"
    shape = lambda n: f"coalesce({_map(H.HANDSHAPES, flat(n))}, CASE WHEN {flat(n)} IN ('', 'NA', '0') THEN '' ELSE 'a ''' || {flat(n)} || ''' handshape' END)"
    return f"""WITH x AS (SELECT p_partkey, upper(p_name) AS gloss, p_partkey % 23 > 0 AS known, {fields} FROM part),
        y AS (SELECT *, {shape('shape')} AS a, {shape('other')} AS b, coalesce({_map(H.SPOTS, flat('minor'))}, {_map(H.PLACES, flat('major'))}, 'in front of you') AS place, coalesce(sign_type, '') AS kind, coalesce(repeated = '1', false) AS again FROM x),
        z AS (SELECT *, CASE WHEN kind IN ('OneHanded', '', 'NA') THEN CASE WHEN a <> '' THEN 'Make ' || a || ' with one hand.' ELSE 'Use one hand as the reference shows.' END
                             WHEN kind = 'SymmetricalOrAlternating' THEN CASE WHEN a <> '' THEN 'Use both hands in ' || a || ', mirrored.' ELSE 'Use both hands, mirrored.' END
                             WHEN a = '' THEN 'Use two hands as the reference shows.' WHEN b <> '' AND a <> b THEN 'Your dominant hand makes ' || a || ' and your other (still) hand makes ' || b || '.' ELSE 'Make ' || a || ' with your dominant hand over your other hand.' END AS hands,
                     CASE WHEN coalesce(movement = 'None', false) THEN 'Hold it ' || place || CASE WHEN again THEN ', tapping in place' ELSE '' END ELSE 'Position it ' || place || ' and ' || coalesce({_map(H.MOVES, "coalesce(movement, '')")}, 'move it as the reference shows') || CASE WHEN again THEN ', repeating the motion' ELSE '' END END || '.' AS moves FROM y)
        SELECT p_partkey,
               CASE WHEN known THEN 'Before signing ' || gloss || ', set up: ' || coalesce({_map(H.CARD_HANDSHAPES, bare('card_shape'))}, {_q(H.CARD_HANDSHAPES['NA'])}) || ', ' || coalesce({_map(H.CARD_LOCATIONS, bare('minor'))}, {_map(H.CARD_LOCATIONS, bare('major'))}, {_q(H.CARD_LOCATIONS['NA'])})
                    || ', the hand ' || coalesce({_map(H.CARD_MOVEMENTS, bare('movement'))}, {_q(H.CARD_MOVEMENTS['NA'])}) || CASE WHEN {bare('repeated')} IN ('', '0', 'None') THEN '' ELSE ' and is repeated' END || '. This is a ' || CASE WHEN kind LIKE 'Symm%' OR kind LIKE 'Asymm%' THEN 'two' ELSE 'one' END || '-handed sign.'
                    ELSE 'Before signing ' || gloss || {_q(H.CARD_FALLBACK[1])} END AS card,
               CASE WHEN known THEN concat_ws(' ', CASE WHEN kind LIKE 'Asymm%' THEN {_q(H.FAILURES['Asymm'])} WHEN kind LIKE 'Symm%' THEN {_q(H.FAILURES['Symm'])} END, CASE WHEN {bare('movement')} IN ('', 'Static', 'None') THEN {_q(H.FAILURES['held'])} ELSE {_q(H.FAILURES['moved'])} END, CASE WHEN {bare('contact')} NOT IN ('', '0', 'None') THEN {_q(H.FAILURES['contact'])} END, {_q(H.FAILURES['always'])})
                    ELSE {_q(H.FAILURES['fallback'])} END AS failure,
               CASE WHEN known THEN trim(regexp_replace('To sign ' || gloss || ': ' || hands || ' ' || moves, '\\s+', ' ', 'g')) ELSE {_q(H.HINT_FALLBACK)} END AS make
        FROM z"""


QUERIES = {"sign_hints": (hints, _hints_sql())}
