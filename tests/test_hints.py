"""Every branch of the hint texts."""

import pytest
from pyspark.sql import functions as F

from lernspur.functions import hints as H

SCHEMA = "gloss string, known boolean, shape string, other string, major string, minor string, movement string, repeated string, kind string, contact string"
C = F.col


def rows(spark, *made):
    keys = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"gloss": "DOG", "known": True, **m}.get(k) for k in keys) for m in made], SCHEMA)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"shape": "C", "major": "Head", "minor": "Chin", "movement": "Arc", "repeated": "1", "kind": "OneHanded"}, "a ‘C’ handshape, near the chin, the hand follows an arc and is repeated. This is a one-handed"),
        ({"shape": ' "C"', "major": "Head", "minor": "Elsewhere", "movement": "Static", "repeated": "0", "kind": "SymmetricalOrAlternating"}, "a ‘C’ handshape, near the head, the hand is held with no movement. This is a two-handed"),
        ({"kind": "AsymmetricalSame", "repeated": "None"}, "the documented handshape (see reference), where the reference video shows, the hand matches the reference video's movement. This is a two-handed"),
    ],
)
def test_cards(spark, given, want):
    (r,) = rows(spark, given).select(H.pre_attempt_hint(C("gloss"), C("known"), C("shape"), C("major"), C("minor"), C("movement"), C("repeated"), C("kind")).alias("t")).collect()
    assert r.t == f"Before signing DOG, set up: {want} sign."


def test_unknown_signs_get_general_texts(spark):
    df = rows(spark, {"known": False, "shape": "C"}, {"known": None})
    nothing = [C("shape")] * 7
    for r in df.select(H.pre_attempt_hint(C("gloss"), C("known"), *nothing[:6]).alias("a"), H.generic_failure_hint(C("known"), *nothing[:3]).alias("b"), H.production_hint(C("gloss"), C("known"), *nothing).alias("c")).collect():
        assert r.a == "Before signing DOG, watch the reference once. Note the handshape, the starting location, and how the hand moves."
        assert r.b.startswith("Common failure: rushing the movement") and r.c.startswith("Watch the reference once more")


@pytest.mark.parametrize(
    ("kind", "movement", "contact", "want"),
    [("AsymmX", "Arc", "1", ["Asymm", "moved", "contact"]), ("SymmX", "Static", "0", ["Symm", "held"]), ("OneHanded", None, None, ["held"]), (None, "None", "yes", ["held", "contact"]), ("", "Z", "None", ["moved"])],
)
def test_failures(spark, kind, movement, contact, want):
    (r,) = rows(spark, {"kind": kind, "movement": movement, "contact": contact}).select(H.generic_failure_hint(C("known"), C("kind"), C("movement"), C("contact")).alias("t")).collect()
    assert r.t == " ".join(H.FAILURES[w] for w in [*want, "always"])


FIST, FLAT = "an 'A' (closed fist, thumb up the side)", "a flat 'B' (flat hand, fingers together)"


@pytest.mark.parametrize(
    ("given", "hands"),
    [
        ({"kind": "OneHanded", "shape": "a"}, f"Make {FIST} with one hand."), ({"kind": None, "shape": "NA"}, "Use one hand as the reference shows."), ({"kind": "NA", "shape": " zz "}, "Make a 'zz' handshape with one hand."),
        ({"kind": "SymmetricalOrAlternating", "shape": "a"}, f"Use both hands in {FIST}, mirrored."), ({"kind": "SymmetricalOrAlternating", "shape": None}, "Use both hands, mirrored."),
        ({"kind": "Asymmetrical", "shape": "a", "other": "b"}, f"Your dominant hand makes {FIST} and your other (still) hand makes {FLAT}."), ({"kind": "Asymmetrical", "shape": "b", "other": "flat_b"}, f"Make {FLAT} with your dominant hand over your other hand."),
        ({"kind": "Asymmetrical", "shape": "a", "other": "NA"}, f"Make {FIST} with your dominant hand over your other hand."), ({"kind": "Asymmetrical", "shape": "0", "other": "b"}, "Use two hands as the reference shows."),
    ],
)
@pytest.mark.parametrize(
    ("place", "moves"),
    [
        ({"minor": "Chin", "major": "Hand", "movement": "Curved", "repeated": "1"}, "Position it at your chin and move it along a curved path, repeating the motion."), ({"minor": "NA", "major": "Hand", "movement": "What"}, "Position it on your other hand and move it as the reference shows."),
        ({"minor": None, "major": "Nowhere", "movement": "None", "repeated": "1"}, "Hold it in front of you, tapping in place."), ({"minor": "Neutral", "major": "Neutral", "movement": "None", "repeated": "0"}, "Hold it in the neutral space in front of your chest."),
    ],
)
def test_how_to_make_a_sign(spark, given, hands, place, moves):
    (r,) = rows(spark, {**given, **place, "gloss": "THANK  YOU"}).select(H.production_hint(C("gloss"), C("known"), C("shape"), C("other"), C("major"), C("minor"), C("movement"), C("repeated"), C("kind")).alias("t")).collect()
    assert r.t == f"To sign THANK YOU: {hands} {moves}"
