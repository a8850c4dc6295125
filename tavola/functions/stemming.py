"""Stems of words as column expressions: English and Russian endings, by script.

Words of Latin letters lose the endings of plurals, of past and of present forms, and a final
`y` becomes `i`. Words of Cyrillic letters go through the published Snowball steps for Russian:
an ending counts only behind the first vowel. All other words stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tavola.functions.predicates import word_tokens

# The Russian endings of the published stemmer. Those of the first kind count only
# after `а` or `я`.
GERUND_AFTER = ("в", "вши", "вшись")
GERUND = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
REFLEXIVE = ("ся", "сь")
ADJECTIVE = (
    "ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом",
    "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею",
)
PARTICIPLE_AFTER = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE = ("ивш", "ывш", "ующ")
VERB_AFTER = (
    "ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно",
)
VERB = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен",
    "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й",
    "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
SUPERLATIVE = ("ейше", "ейш")

_V, _C = "[аеиоуыэюя]", "[^аеиоуыэюя]"
#: What follows the first vowel, and in it what follows the second change from vowel to consonant.
_RV = f"^{_C}*{_V}(.*)$"
_R2 = f"^{_C}*{_V}+{_C}{_C}*{_V}+{_C}"


def _any(endings: tuple[str, ...], after: tuple[str, ...] = ()) -> str:
    """Pattern of the endings; the leftmost match at the end of a word is the longest one."""
    own = "|".join(endings)
    return f"(?:(?<=[ая])(?:{'|'.join(after)})|{own})" if after else f"(?:{own})"


_GERUND = _any(GERUND, GERUND_AFTER) + "$"
_REFLEXIVE = _any(REFLEXIVE) + "$"
_ADJECTIVAL = f"{_any(PARTICIPLE, PARTICIPLE_AFTER)}?{_any(ADJECTIVE)}$"
_VERB = _any(VERB, VERB_AFTER) + "$"
_NOUN = _any(NOUN) + "$"
_SUPERLATIVE = _any(SUPERLATIVE) + "$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _first(word: Column, *patterns: str) -> Column:
    """The word without the first of the endings that it has."""
    found = word
    for pattern in reversed(patterns):
        found = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, "")).otherwise(found)
    return found


def russian_stem(word: Column) -> Column:
    """Stem of a lower-case word of Cyrillic letters; one without a vowel stays."""

    def in_region(word: Column, rv: Column) -> Column:
        head = F.substring(word, F.lit(1), F.length(word) - F.length(rv))
        plain = lambda rv: _let(F.regexp_replace(rv, _REFLEXIVE, ""), lambda x: _first(x, _ADJECTIVAL, _VERB, _NOUN))
        cut = F.when(rv.rlike(_GERUND), F.regexp_replace(rv, _GERUND, "")).otherwise(plain(rv))
        return _let(F.regexp_replace(cut, "и$", ""), lambda rv: _let(_derived(head, rv), _ended))

    def _derived(head: Column, rv: Column) -> Column:
        """Head and region, without `ост` or `ость` where it lies behind the second change."""
        short = F.regexp_replace(rv, "ость?$", "")
        whole = F.concat(head, short)
        return F.struct(head.alias("head"), F.when(whole.rlike(_R2), short).otherwise(rv).alias("rv"))

    def _ended(parts: Column) -> Column:
        rv = parts["rv"]
        single = lambda x: F.regexp_replace(x, "нн$", "н")
        end = (
            F.when(rv.rlike(_SUPERLATIVE), single(F.regexp_replace(rv, _SUPERLATIVE, "")))
            .when(rv.rlike("нн$"), single(rv))
            .otherwise(F.regexp_replace(rv, "ь$", ""))
        )
        return F.concat(parts["head"], end)

    plain = F.translate(word, "ё", "е")
    return _let(
        plain, lambda w: F.when(w.rlike(_V), _let(F.regexp_extract(w, _RV, 1), lambda rv: in_region(w, rv))).otherwise(w)
    )


def english_stem(word: Column) -> Column:
    """A lower-case word of Latin letters without the endings of plurals and of verb forms."""

    def plural(w: Column) -> Column:
        return (
            F.when(w.rlike("sses$"), F.regexp_replace(w, "es$", ""))
            .when(w.rlike("^..+ie[sd]$"), F.regexp_replace(w, "e[sd]$", ""))
            .when(w.rlike("^.ie[sd]$"), F.regexp_replace(w, "[sd]$", ""))
            .otherwise(F.regexp_replace(w, "^(.*[aeiouy].*[^us])s$", "$1"))
        )

    def filled(w: Column) -> Column:
        return (
            F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(w.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.regexp_replace(w, ".$", ""))
            .when(w.rlike("^[^aeiouy]*[aeiouy][^aeiouywx]$"), F.concat(w, F.lit("e")))
            .otherwise(w)
        )

    def verb(w: Column) -> Column:
        return (
            F.when(w.rlike("[aeiouy][^aeiouy].*eed(ly)?$"), F.regexp_replace(w, "d(ly)?$", ""))
            .when(w.rlike("eed(ly)?$"), w)
            .when(w.rlike("[aeiouy].*(ed|ing)(ly)?$"), _let(F.regexp_replace(w, "(ed|ing)(ly)?$", ""), filled))
            .otherwise(w)
        )

    final = _let(_let(word, plural), verb)
    return F.when(F.length(word) <= 2, word).otherwise(F.regexp_replace(final, "^(.+[^aeiouy])y$", "$1i"))


def stem(word: Column) -> Column:
    """Stem of a lower-case word, by the letters it is made of."""
    return (
        F.when(word.rlike("^[a-z]+$"), english_stem(word))
        .when(word.rlike("^[а-яё]+$"), russian_stem(word))
        .otherwise(word)
    )


def word_stems(column: str | Column) -> Column:
    """Distinct stems of a text's words; null for a null text."""
    return F.array_distinct(F.transform(F.array_distinct(word_tokens(column)), stem))


def has_all_stems(column: str | Column, keywords: str) -> Column:
    """True where the text has a form of every word of `keywords`; without words, nowhere."""
    wanted = word_stems(F.lit(keywords))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, word_stems(column))) == 0)
