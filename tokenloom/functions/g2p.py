"""Indonesian pronunciation (FN11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with an e of their own. Fixed values.
E_WORDS = {"emas": "əmas", "merah": "mɛrah", "berak": "bɛrak", "enak": "enak", "empat": "əmpat", "enam": "ənam"}
#: Spellings that change and what they become, in order. Fixed values. Letters that stay
#: as they are need no rule.
SPELLINGS = (
    ("ai", "ai̯"), ("au", "au̯"), ("oi", "oi̯"),
    ("ng", "ŋ"), ("ny", "ɲ"), ("sy", "ʃ"), ("kh", "x"),
    ("c", "tʃ"), ("j", "dʒ"), ("y", "j"), ("x", "ks"), ("q", "k"),
)
VOWELS = "aiueoəɛɔ"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"

# Where a syllable ends: between two vowels, before one consonant and a vowel, and within
# two consonants before a vowel.
_ENDS = rf"([{VOWELS}])(?=[^{VOWELS}]?[{VOWELS}])|([{VOWELS}][^{VOWELS}])(?=[^{VOWELS}][{VOWELS}])"


def syllables(word: Column) -> Column:
    """Syllables divided by dots."""
    return F.regexp_replace(word, _ENDS, "$1$2.")


def ipa(token: Column, divide: bool = True, e_words: dict[str, str] | None = None) -> Column:
    """A word in phonetic letters, syllables divided by dots; markup comes back as it is,
    null for null. Spark functions only. Apply it to distinct words."""
    word = F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))
    listed = F.create_map(*[F.lit(x) for pair in (E_WORDS if e_words is None else e_words).items() for x in pair])
    first = F.regexp_replace(word, rf"^([bmpkst])e(?=[{CONSONANTS}])", "$1ə")
    vowels = F.replace(F.regexp_replace(first, "e(?=[rktp])", "ɛ"), F.lit("e"), F.lit("ə"))
    out = F.regexp_replace(F.coalesce(F.try_element_at(listed, word), vowels), rf"o(?=[{CONSONANTS}])", "ɔ")
    for spelling, sound in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(sound))
    out = F.regexp_replace(out, r"k(?![\p{L}\p{N}_])", "ʔ")
    return F.when(word.rlike(r"[<>{}=\\/]"), token).otherwise(syllables(out) if divide else out)
