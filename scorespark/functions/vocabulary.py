"""Fixed token values of the six branches and small constant maps.

These are data-format values: they have to be exactly these strings, in this order, because ids follow the order.
Long lists are generated from their rule.
"""

from __future__ import annotations

NOT_APPLICABLE = "."
EMPTY = "_"

TOKEN_FIELDS = ("rhythm", "pitch", "lift", "articulation", "slur", "position")
SCORED_FIELDS = ("rhythm", "pitch", "lift", "articulation", "slur")

MAX_SEQUENCE_LENGTH = 608
MAX_LEDGER_LINES = 5

# Control tokens, bar lines, repeats, voltas.
CONTROL_TOKENS = ["PAD", "BOS", "EOS", "chord"]
BARLINE_TOKENS = ["barline", "doublebarline", "bolddoublebarline"]
REPEAT_TOKENS = ["repeatStart", "repeatEnd", "repeatEndStart"]
VOLTA_TOKENS = ["voltaStart", "voltaStop", "voltaDiscontinue"]
CLEF_TOKENS = [
    "clef_F3", "clef_F4", "clef_F5", "clef_C1", "clef_C2", "clef_C3", "clef_C4", "clef_C5", "clef_G1", "clef_G2",
    "clef_TAB5",
]
TIME_DENOMINATORS = [1, 2, 3, 4, 6, 8, 12, 16, 32, 48]
KERN_BASES = [0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 32, 64, 128]
IRREGULAR_BASES = [7, 11, 13, 18, 20, 21, 22, 24, 26, 28, 30, 34, 36, 40, 48, 56, 96]

# Lifts, positions, slurs.
LIFT_TOKENS = [".", "_", "#", "##", "N", "b", "bb"]
POSITION_TOKENS = [".", "upper", "lower"]
SLUR_TOKENS = [".", "_", "slurStart_slurStop", "slurStart", "slurStop"]

# Articulation combinations that occur in the corpora.
ARTICULATION_TOKENS = """
. _ accent accent_arpeggiate accent_arpeggiate_fermata accent_arpeggiate_staccato accent_arpeggiate_tenuto
accent_breathMark accent_breathMark_fermata accent_fermata accent_fermata_tremolo accent_staccatissimo
accent_staccato accent_staccato_tenuto accent_staccato_tremolo accent_staccato_trill accent_tenuto accent_tremolo
accent_trill arpeggiate arpeggiate_breathMark arpeggiate_fermata arpeggiate_fermata_staccato
arpeggiate_fermata_tenuto arpeggiate_staccatissimo arpeggiate_staccatissimo_staccato arpeggiate_staccato
arpeggiate_staccato_tenuto arpeggiate_tenuto arpeggiate_tremolo arpeggiate_trill breathMark breathMark_fermata
breathMark_fermata_tenuto breathMark_staccato breathMark_tenuto breathMark_tremolo breathMark_trill fermata
fermata_staccato fermata_tenuto fermata_tremolo fermata_trill fermata_turn staccatissimo staccatissimo_staccato
staccatissimo_staccato_tenuto staccatissimo_staccato_tenuto_trill staccatissimo_tenuto staccato staccato_tenuto
staccato_tremolo staccato_trill staccato_turn tenuto tenuto_tremolo tenuto_trill tremolo trill trill_turn turn
""".split()

PITCH_LETTERS = "CDEFGAB"

# Pitch on the middle staff line of each clef.
CLEF_MIDDLE_PITCH = {
    "clef_G1": "D5", "clef_G2": "B4", "clef_F3": "F3", "clef_F4": "D3", "clef_F5": "B2",
    "clef_C1": "G4", "clef_C2": "E4", "clef_C3": "C4", "clef_C4": "A3", "clef_C5": "F3",
}

# Major key name to position on the circle of fifths.
KEY_FIFTHS = {
    "CbM": -7, "GbM": -6, "DbM": -5, "AbM": -4, "EbM": -3, "BbM": -2, "FM": -1, "CM": 0,
    "GM": 1, "DM": 2, "AM": 3, "EM": 4, "BM": 5, "F#M": 6, "C#M": 7,
}

# Articulations one corpus does not transcribe reliably.
UNRELIABLE_ARTICULATIONS = ["staccato", "staccatissimo", "turn"]


def pitch_tokens() -> list[str]:
    """High to low, after the two sentinels."""
    return [".", "_"] + [f"{PITCH_LETTERS[step]}{octave}" for octave in range(9, -1, -1) for step in range(6, -1, -1)]


def duration_tokens(kind: str) -> list[str]:
    regular = [
        f"{kind}_{base}{grace}{'.' * dots}" for base in KERN_BASES for grace in ("", "G") for dots in range(3)
    ]
    return regular + [f"{kind}_{base}" for base in IRREGULAR_BASES]


def rhythm_tokens() -> list[str]:
    return (
        CONTROL_TOKENS
        + BARLINE_TOKENS
        + REPEAT_TOKENS
        + VOLTA_TOKENS
        + CLEF_TOKENS
        + [f"keySignature_{fifths}" for fifths in range(-7, 8)]
        + [f"timeSignature/{d}" for d in TIME_DENOMINATORS]
        + [f"rest_{n}m" for n in range(2, 11)]
        + duration_tokens("note")
        + duration_tokens("rest")
    )


def branch_tokens() -> dict[str, list[str]]:
    return {
        "rhythm": rhythm_tokens(),
        "pitch": pitch_tokens(),
        "lift": LIFT_TOKENS,
        "articulation": ARTICULATION_TOKENS,
        "slur": SLUR_TOKENS,
        "position": POSITION_TOKENS,
    }
