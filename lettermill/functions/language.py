"""The language of a text by its function words, as an Arrow-friendly Python function.

A plain stand-in for a model: a caller may pass a better detector wherever this one is the default.
"""

from __future__ import annotations

import re

#: Frequent words without much meaning, by language code.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or had by but not what all were we when your can said there use an each which she do how their if will up about out many then them these so some her would make him into has you our more",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir ihr",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son mais comme on tout nous sa fait aux cette ses elle leur bien si entre sans peut lui ces vous je",
    "es": "de la que el en y a los del se las por un para con no una su al lo como pero sus le ya o este porque cuando muy sin sobre ser tiene hasta hay donde quien desde todo nos durante todos uno les ni otros ese eso yo",
    "it": "di che la il un a per in una sono mi ho non con lo ma se ti le si come da cosa gli del della questo bene anche nel alla dei era stato essere hanno delle suo",
    "pt": "que de a o e do da em um para com uma os no se na por mais as dos como mas foi ao ele das tem seu sua ou ser quando muito nos eu pelo pela isso ela entre era depois sem mesmo aos",
    "nl": "de van het een en in is dat op te zijn met voor die niet aan er om ook als dan maar bij nog uit door naar heeft hij ze wordt tot je over hebben deze kan werd",
}
#: Share of the best score by which it must lead the second, and function words seen at least.
RELATIVE_DISTANCE, LEAST = 0.20, 3

_WORD = re.compile(r"[^\W\d_]+")
_SETS = {code: frozenset(words.split()) for code, words in FUNCTION_WORDS.items()}


def detect(text: str) -> tuple[str | None, float | None]:
    """(code, confidence): the language whose function words are the most, and their share of all found; no code if others come near."""
    words = _WORD.findall(text.casefold())
    found = {code: sum(w in own for w in words) for code, own in _SETS.items()}
    (code, best), (_, second) = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:2]
    confidence = best / total if (total := sum(found.values())) else None
    return (code if best >= LEAST and best - second >= RELATIVE_DISTANCE * best else None), confidence


def gazetteer(people: list[str], organisations: list[str] = ()):
    """A recogniser of names (see mail.Recogniser) that are listed, whole words, longest first."""
    kinds = {name.casefold(): kind for kind, names in (("ORG", organisations), ("PERSON", people)) for name in names}
    if not kinds:
        return lambda _: []
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(kinds, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    return lambda text: [(m.start(), m.end(), kinds[m[0].casefold()]) for m in pattern.finditer(text)]
