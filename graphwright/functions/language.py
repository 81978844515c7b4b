"""Language names, support and a deterministic language detector."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code to name. Fixed values.
NAMES = {
    "ru": "Русский", "en": "English", "fr": "Français", "de": "Deutsch", "es": "Español", "it": "Italiano", "pt": "Português",
    "nl": "Nederlands", "pl": "Polski", "uk": "Українська", "be": "Беларуская", "zh": "中文", "ja": "日本語", "ko": "한국어",
}
SUPPORTED = ("ru", "en")
CLOSEST = {"ru": ("uk", "be"), "en": ("de", "nl", "fr", "es", "it", "pt", "pl")}
#: Frequent function words by which languages are told apart. Fixed values.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as be this by at from or an which you have not",
    "de": "der die und das ist von zu den mit sich des auf für nicht ein eine dem im es auch als an werden",
    "fr": "le la les de des et un une est que qui dans pour sur pas au par plus ce avec il ne se sont du",
    "es": "el la los las de que y en un una es por con para no se del al lo como más su pero sus este",
    "ru": "и в не на я что он с как это по но они мы из у за от то для же все так о был",
}
#: Letters that point to one language. Fixed values.
LETTERS = {"de": "äöüß", "fr": "éèêçàùâîôûœ", "es": "ñóíúá¿¡", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}
#: Characters that are looked at.
SAMPLE = 1000


def language_name(code: Column) -> Column:
    """The name of a code (any case), or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(code)), code)


def is_supported(code: Column) -> Column:
    return F.lower(code).isin(*SUPPORTED)


def closest_supported(code: Column) -> Column:
    """The code itself where supported, else the nearest supported language (groups are case-sensitive)."""
    out = F.when(is_supported(code), code)
    for language, near in CLOSEST.items():
        out = out.when(code.isin(*near), language)
    return out.otherwise("en")


def _score(text: str | None) -> str | None:
    if text is None or not text.strip():
        return None
    sample = " ".join(text.split())[:SAMPLE].lower()
    words = [w.strip(".,;:!?()[]\"'|") for w in sample.split(" ")]
    best, most = "en", 0.0
    for language, stops in STOP_WORDS.items():
        known = set(stops.split())
        score = sum(w in known for w in words) / max(1, len(words))
        score += 3 * sum(c in LETTERS.get(language, "") for c in sample) / max(1, len(sample))
        if score > most:
            best, most = language, score
    return best


def detect_language(text: Column) -> Column:
    """The most likely of en, de, fr, es and ru by function words and letters; null for blank texts."""

    @F.pandas_udf("string")
    def detect(values: pd.Series) -> pd.Series:
        return values.map(_score)

    # Blanks are collapsed before the text is cut, so that no run of them can use the sample up.
    return detect(F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, SAMPLE + 1))


def prompt_for(prompts: dict[str, dict[str, str]], key: str, language: str) -> str:
    """The prompt of a language, English where that has none."""
    for code in (language.lower(), "en"):
        if key in prompts.get(code, {}):
            return prompts[code][key]
    raise KeyError(key)
