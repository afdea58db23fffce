"""Language codes as documents spell them."""

from __future__ import annotations

#: Other spellings of the two-letter codes. Fixed values.
CODES = {
    "eng": "en", "in": "id", "ind": "id", "jp": "ja", "jpn": "ja", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "chi": "zh", "zho": "zh", "cn": "zh",
    "ara": "ar", "hin": "hi", "tha": "th",
}


def code_of(lang: str | None) -> str | None:
    """The two-letter code of a language however it is written; null if there is none."""
    low = (lang or "").strip().lower()
    return CODES.get(low[:3].rstrip("-_"), low[:2]) or None
