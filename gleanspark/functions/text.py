"""Functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages whose short texts are measured in characters.
CHARACTER_LANGUAGES = ["japanese", "korean", "koreana", "schinese", "tchinese"]

#: Display names of language codes.
LANGUAGE_NAMES = {
    "english": "English",
    "koreana": "한국어",
    "japanese": "日本語",
    "schinese": "简体中文",
    "tchinese": "繁體中文",
    "russian": "Русский",
    "spanish": "Español (ES)",
    "latam": "Español (LA)",
    "french": "Français",
    "german": "Deutsch",
    "portuguese": "Português",
    "brazilian": "Português (BR)",
    "italian": "Italiano",
    "polish": "Polski",
    "turkish": "Türkçe",
    "thai": "ไทย",
    "vietnamese": "Tiếng Việt",
    "ukrainian": "Українська",
    "czech": "Čeština",
    "dutch": "Nederlands",
    "hungarian": "Magyar",
    "romanian": "Română",
    "swedish": "Svenska",
    "finnish": "Suomi",
    "danish": "Dansk",
    "norwegian": "Norsk",
    "indonesian": "Bahasa Indonesia",
    "arabic": "العربية",
    "greek": "Ελληνικά",
    "bulgarian": "Български",
}

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_WORD = r"[^\s\x1c-\x1f\x85\p{Z}]"


def stripped(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}+|{_SPACE}+$", "")


def has_words(text: Column, n: int) -> Column:
    """Whether a text has at least ``n`` words; what comes after the n-th is not read."""
    return F.coalesce(text, F.lit("")).rlike(f"^{_SPACE}*+(?:{_WORD}++{_SPACE}++){{{n - 1}}}{_WORD}") if n > 0 else F.lit(True)


def is_short(text: Column, language: Column, min_words: int = 5) -> Column:
    """Under ``min_words`` words; in languages without word blanks under twice as many characters."""
    by_length = F.length(stripped(text)) < max(1, 2 * min_words)
    return F.when(F.lower(F.coalesce(language, F.lit(""))).isin(CHARACTER_LANGUAGES), by_length).otherwise(~has_words(text, min_words))


def language_name(code: Column) -> Column:
    """The display name of a language code, or the code itself."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, code), code)


def truncate_review(text: Column, most: int = 400) -> Column:
    """At most ``most`` characters, cut after the last sentence end in the second half, and marked where cut."""
    cut = F.substring(text, 1, most)

    def last(mark: str) -> Column:
        at = F.instr(F.reverse(cut), mark[::-1])
        return F.when(at == 0, F.lit(-1)).otherwise(F.length(cut) - at - len(mark) + 1)

    end = F.greatest(last(". "), last("! "), last("? "), last("\n"))
    body = F.when(end > most * 0.5, F.substr(cut, F.lit(1), end + 1)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(body, F.lit(" [...]")))


def estimate_minutes(n: Column, per_minute: int = 450) -> Column:
    """Minutes an analysis of ``n`` reviews is expected to take."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / per_minute))).cast("long")


def topic_name(topic_id: Column, label: Column | None = None) -> Column:
    plain = F.concat(F.lit("Topic "), topic_id.cast("string"))
    return plain if label is None else F.coalesce(label, plain)


def embedded_counts(message: Column) -> Column:
    """(processed, total) of a progress message that says "Embedded 1,234/5,678"; null for any other."""
    number = lambda i: F.replace(F.regexp_extract(message, r"Embedded (\d[\d,]*)\s*/\s*(\d[\d,]*)", i), F.lit(",")).try_cast("long")
    return F.when(number(2).isNotNull(), F.struct(number(1).alias("processed"), number(2).alias("total")))
