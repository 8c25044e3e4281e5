"""Texts of hints from the fields of a sign lexicon: what to set up, what often fails, how to make a sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases learners see, by the lexicon's codes. Cards before an attempt:

CARD_HANDSHAPES = {
    "1": "an index-finger ‘1’ handshape", "5": "an open ‘5’ handshape", "A": "a fist ‘A’ handshape", "B": "a flat ‘B’ handshape", "Flat-B": "a flat ‘B’ handshape", "Bent-B": "a bent ‘B’ handshape",
    "Bent-5": "a clawed ‘5’ handshape", "Curved-5": "a curved ‘5’ handshape", "Curved-B": "a curved ‘B’ handshape", "C": "a ‘C’ handshape", "F": "an ‘F’ handshape", "G": "a ‘G’ handshape", "H": "an ‘H’ handshape",
    "I": "an ‘I’ handshape", "K": "a ‘K’ handshape", "L": "an ‘L’ handshape", "O": "an ‘O’ handshape", "S": "an ‘S’ handshape (closed fist)", "U": "a ‘U’ handshape", "V": "a ‘V’ handshape", "W": "a ‘W’ handshape",
    "Y": "a ‘Y’ handshape", "3": "a ‘3’ handshape", "8": "an ‘8’ handshape", "10": "a thumbs-up ‘10’ handshape", "Open-A": "an open-‘A’ handshape (thumb extended)", "Open-B": "an open-‘B’ handshape",
    "Open-F": "an open-‘F’ handshape", "Crooked-1": "a crooked-‘1’ handshape", "Bent-V": "a bent-‘V’ handshape", "Flat-O": "a flat-‘O’ handshape", "Baby-O": "a baby-‘O’ handshape", "ILY": "an ILY handshape (I-Love-You)",
    "NA": "the documented handshape (see reference)",
}
CARD_LOCATIONS = {
    "Head": "near the head", "Forehead": "near the forehead", "Eye": "at eye level", "Cheek": "near the cheek", "Chin": "near the chin", "Mouth": "near the mouth", "Nose": "near the nose", "Ear": "near the ear",
    "Body": "near the body", "Chest": "at chest level", "Neck": "near the neck", "Stomach": "near the stomach", "Trunk": "at chest level", "Shoulder": "near the shoulder", "Arm": "near the opposite arm",
    "Forearm": "near the forearm", "Hand": "on the non-dominant hand", "Wrist": "near the wrist", "Neutral": "in neutral space in front of you", "NA": "where the reference video shows",
}
CARD_MOVEMENTS = {
    "Straight": "moves in a straight line", "Curved": "follows a curved path", "Circular": "moves in a circular pattern", "Arc": "follows an arc", "Wiggling": "with fingers wiggling", "Twist": "with a twisting motion",
    "Bend": "with a bending motion at the joints", "Rub": "with a rubbing motion", "Static": "is held with no movement", "None": "is held with no movement", "Hooking": "with a hooking motion",
    "BackAndForth": "moves back and forth", "NA": "matches the reference video's movement",
}
CARD_FALLBACK = ("Before signing ", ", watch the reference once. Note the handshape, the starting location, and how the hand moves.")
FAILURES = {
    "Asymm": "Common failure: the non-dominant hand drops position or rotates; keep it steady.",
    "Symm": "Common failure: the two hands fall out of mirror symmetry; both hands should move identically.",
    "moved": "Common failure: the movement is cut short; let the full motion complete.",
    "held": "Common failure: the hand drifts during the hold; keep position stable.",
    "contact": "Common failure: missing the contact point; the hand should actually touch the indicated location.",
    "always": "If unsure, watch the reference and check: handshape, palm orientation, location, movement, facial expression.",
    "fallback": "Common failure: rushing the movement before the handshape is set. Slow down, form the handshape first, then perform the movement.",
}

# How to make a sign.

HANDSHAPES = {
    "1": "a '1' (index finger pointing up, others closed)", "bent_1": "a bent-1 (crooked index finger)", "flat_1": "a flat-1 (index out, hand flattened)", "curved_1": "a curved-1 (slightly hooked index)",
    "3": "a '3' (thumb, index and middle fingers out)", "4": "a '4' (four fingers up, thumb tucked)", "flat_4": "a flat-4 (four fingers out and flattened)", "curved_4": "a curved-4 (four fingers slightly bent)",
    "5": "an open '5' (all five fingers spread)", "curved_5": "a curved-5 (claw hand, fingers spread and bent)", "flatspread_5": "a flat spread-5 (flat hand, fingers apart)", "stacked_5": "a stacked-5 (loose claw, fingers stacked)",
    "7": "a '7' (ring finger touching thumb)", "8": "an '8' (middle finger touching thumb)", "open_8": "an open-8 (middle finger bent toward thumb, hand open)", "a": "an 'A' (closed fist, thumb up the side)",
    "s": "an 'S' (closed fist, thumb across the front)", "b": "a flat 'B' (flat hand, fingers together)", "open_b": "an open 'B' (flat hand, fingers spread a little)", "flat_b": "a flat 'B' (flat hand, fingers together)",
    "closed_b": "a closed 'B' (flat hand, thumb tucked in)", "c": "a 'C' (hand curved into a C shape)", "d": "a 'D' (index up, thumb and middle finger forming a circle)", "e": "an 'E' (fingertips curled to the thumb)",
    "open_e": "an open 'E' (loosely curled fingers)", "spread_open_e": "a spread open-E (fingers loosely curled and apart)", "spread_e": "a spread 'E' (curled fingers held apart)", "closed_e": "a closed 'E' (tightly curled fingers)",
    "f": "an 'F' (index and thumb form a circle, other fingers up)", "open_f": "an open 'F' (thumb-index circle, fingers spread)", "g": "a 'G' (index and thumb extended, pointing sideways)", "h": "an 'H' (index and middle fingers out together)",
    "flat_h": "a flat 'H' (index and middle out and flattened)", "open_h": "an open 'H' (index and middle out and apart)", "curved_h": "a curved 'H' (index and middle out and slightly bent)", "i": "an 'I' (pinky finger up, others closed)",
    "ily": "an ILY (thumb, index and pinky out)", "flat_ily": "a flat-ILY (thumb, index and pinky out, hand flattened)", "k": "a 'K' (index up, middle out, thumb between them)", "l": "an 'L' (index up, thumb out, forming an L)",
    "curved_l": "a curved 'L' (L shape with a bent index)", "bent_l": "a bent 'L' (L shape with a crooked index)", "flat_l": "a flat 'L' (L shape with the hand flattened)", "m": "an 'M' (thumb under three fingers)",
    "flat_m": "a flat 'M' (M shape, hand flattened)", "n": "an 'N' (thumb under two fingers)", "flat_n": "a flat 'N' (N shape, hand flattened)", "o": "an 'O' (fingers and thumb form a round O)",
    "flat_o": "a flat-O (fingertips pinched to the thumb)", "baby_o": "a baby-O (a small O made with the index and thumb)", "p": "a 'P' (K shape pointed downward)", "r": "an 'R' (index and middle fingers crossed)",
    "t": "a 'T' (fist with the thumb between index and middle)", "v": "a 'V' (index and middle fingers up in a V)", "bent_v": "a bent-V (index and middle fingers up and hooked)", "curved_v": "a curved 'V' (V shape with both fingers slightly bent)",
    "flat_v": "a flat 'V' (V shape with the hand flattened)", "w": "a 'W' (index, middle and ring fingers up)", "y": "a 'Y' (thumb and pinky out, others closed)", "horns": "a horns hand (index and pinky out)",
    "flat_horns": "a flat horns hand (index and pinky out, hand flattened)", "goody_goody": "a 'goody-goody' hand (a loose claw shape)",
}
PLACES = {
    "Neutral": "in the neutral space in front of your chest", "Head": "up at your head", "Body": "in front of your body", "Arm": "near your forearm", "Hand": "on your other hand", "Other": "in front of you",
}
SPOTS = {
    "Forehead": "at your forehead", "Eye": "near your eye", "CheekNose": "by your cheek or nose", "Chin": "at your chin", "UnderChin": "under your chin", "Mouth": "at your mouth", "UpperLip": "at your upper lip",
    "HeadTop": "at the top of your head", "HeadAway": "just out from your head", "Neck": "at your neck", "Clavicle": "at your collarbone", "Shoulder": "at your shoulder", "UpperArm": "on your upper arm", "TorsoTop": "high on your chest",
    "TorsoMid": "at the middle of your chest", "TorsoBottom": "low on your torso", "Hips": "at your hips", "Waist": "at your waist", "Heel": "at the heel of your hand", "Palm": "in the palm of your other hand",
    "PalmBack": "on the back of your other hand", "FingerTip": "at your fingertips", "FingerBack": "on the back of your fingers", "FingerFront": "on the front of your fingers", "FingerRadial": "along the thumb side of your fingers",
    "FingerUlnar": "along the pinky side of your fingers", "WristBack": "on the back of your wrist", "WristFront": "on the inside of your wrist", "ForearmBack": "on the back of your forearm", "ForearmFront": "on the front of your forearm",
    "ForearmUlnar": "along the underside of your forearm", "ElbowBack": "at your elbow", "BodyAway": "just out from your body", "HandAway": "just out from your other hand", "ArmAway": "just out from your arm",
}
MOVES = {
    "Straight": "move it in a straight line", "Curved": "move it along a curved path", "Circular": "move it in a circle", "Z-shaped": "trace a Z-shaped path", "X-shaped": "trace a crossing X-shaped path",
    "BackAndForth": "move it back and forth", "Other": "move it as the reference shows",
}
HINT_FALLBACK = "Watch the reference once more and copy it in three steps: match the hand shape, place your hand where the signer's is, then trace the same movement."

# ---- rules


def _said(names: dict[str, str], code: Column) -> Column:
    """The phrase of a code; null for a code that has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)


def _bare(code: Column) -> Column:
    """A code without the white space and then the quotation marks around it; empty for null."""
    return F.regexp_replace(F.trim(F.coalesce(code, F.lit(""))), '^"+|"+$', "")


def pre_attempt_hint(gloss: Column, known: Column, handshape: Column, major: Column, minor: Column, movement: Column, repeated: Column, sign_type: Column) -> Column:
    """The card shown before an attempt; signs that the lexicon does not know (``known`` false) get a general one."""
    shape = F.coalesce(_said(CARD_HANDSHAPES, _bare(handshape)), F.lit(CARD_HANDSHAPES["NA"]))
    place = F.coalesce(_said(CARD_LOCATIONS, _bare(minor)), _said(CARD_LOCATIONS, _bare(major)), F.lit(CARD_LOCATIONS["NA"]))
    again = F.when(_bare(repeated).isin("", "0", "None"), "").otherwise(" and is repeated")
    move = F.concat(F.coalesce(_said(CARD_MOVEMENTS, _bare(movement)), F.lit(CARD_MOVEMENTS["NA"])), again)
    hands = F.when(_bare(sign_type).rlike("^(Symm|Asymm)"), "two-handed").otherwise("one-handed")
    card = F.concat(F.lit("Before signing "), gloss, F.lit(", set up: "), shape, F.lit(", "), place, F.lit(", the hand "), move, F.lit(". This is a "), hands, F.lit(" sign."))
    return F.when(F.coalesce(known, F.lit(False)), card).otherwise(F.concat(F.lit(CARD_FALLBACK[0]), gloss, F.lit(CARD_FALLBACK[1])))


def generic_failure_hint(known: Column, sign_type: Column, movement: Column, contact: Column) -> Column:
    """Sentences on what often fails, by sign type, movement and contact; signs that the lexicon does not know get a general one."""
    kind = _bare(sign_type)
    hands = F.when(kind.startswith("Asymm"), FAILURES["Asymm"]).when(kind.startswith("Symm"), FAILURES["Symm"])
    move = F.when(_bare(movement).isin("", "Static", "None"), FAILURES["held"]).otherwise(FAILURES["moved"])
    touch = F.when(~_bare(contact).isin("", "None", "0"), FAILURES["contact"])
    return F.when(F.coalesce(known, F.lit(False)), F.concat_ws(" ", hands, move, touch, F.lit(FAILURES["always"]))).otherwise(FAILURES["fallback"])


def _shape(code: Column) -> Column:
    """The phrase of a handshape: an unknown code is named as it is, none gives an empty text."""
    own = F.trim(F.coalesce(code, F.lit("")))
    return F.coalesce(_said(HANDSHAPES, own), F.when(own.isin("", "NA", "0"), "").otherwise(F.concat(F.lit("a '"), own, F.lit("' handshape"))))


def production_hint(gloss: Column, known: Column, handshape: Column, other: Column, major: Column, minor: Column, movement: Column, repeated: Column, sign_type: Column) -> Column:
    """Two sentences: hands and their shapes, then place, movement and repetition; signs that the lexicon does not know get a general text."""
    shape, still, kind = _shape(handshape), _shape(other), F.coalesce(sign_type, F.lit(""))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    both = F.when(shape != "", text("Use both hands in ", shape, ", mirrored.")).otherwise(F.lit("Use both hands, mirrored."))
    unlike = F.when((shape != "") & (still != "") & (still != shape), text("Your dominant hand makes ", shape, " and your other (still) hand makes ", still, ".")).when(shape != "", text("Make ", shape, " with your dominant hand over your other hand.")).otherwise(F.lit("Use two hands as the reference shows."))
    one = F.when(shape != "", text("Make ", shape, " with one hand.")).otherwise(F.lit("Use one hand as the reference shows."))
    hands = F.when(kind.isin("OneHanded", "", "NA"), one).when(kind == "SymmetricalOrAlternating", both).otherwise(unlike)
    spot, again = F.trim(F.coalesce(minor, F.lit(""))), F.coalesce(repeated == "1", F.lit(False))
    place = F.coalesce(_said(SPOTS, spot), _said(PLACES, F.trim(F.coalesce(major, F.lit("")))), F.lit("in front of you"))
    held = text("Hold it ", place, F.when(again, ", tapping in place").otherwise(""), ".")
    moved = text("Position it ", place, " and ", F.coalesce(_said(MOVES, F.coalesce(movement, F.lit(""))), F.lit(MOVES["Other"])), F.when(again, ", repeating the motion").otherwise(""), ".")
    hint = text("To sign ", gloss, ": ", hands, " ", F.when(F.coalesce(movement == "None", F.lit(False)), held).otherwise(moved))
    return F.when(F.coalesce(known, F.lit(False)), F.trim(F.regexp_replace(hint, r"\s+", " "))).otherwise(F.lit(HINT_FALLBACK))
