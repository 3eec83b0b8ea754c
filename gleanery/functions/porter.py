"""English stems after Porter (1980), of single words; no Spark in here."""

from __future__ import annotations

import functools
import re

# The suffixes of Porter's steps 2, 3 and 4, and the English stop words that a search leaves out.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def _form(word: str) -> str:
    """v for each vowel, c for each other letter; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(part: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _form(part)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends with consonant, vowel, consonant, the last not w, x or y."""
    return _form(word).endswith("cvc") and word[-1] not in "wxy"


_LONGEST = lambda pairs: tuple(sorted(pairs, key=lambda p: -len(p[0])))
_STEP2, _STEP3, _STEP4 = _LONGEST(STEP2), _LONGEST(STEP3), tuple(sorted(STEP4, key=len, reverse=True))


def _swapped(word: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for suffix, other in pairs:
        if word.endswith(suffix):
            part = word[: -len(suffix)]
            return part + other if _measure(part) > 0 else word
    return word


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with letters beyond a to z, and of two letters, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # Plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and continuous forms.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                part = word[: -len(suffix)]
                if "v" in _form(part):
                    if part.endswith(("at", "bl", "iz")) or (_measure(part) == 1 and _short(part)):
                        part += "e"
                    elif _double(part) and part[-1] not in "lsz":
                        part = part[:-1]
                    word = part
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _swapped(_swapped(word, _STEP2), _STEP3)
    for suffix in _STEP4:
        if word.endswith(suffix):
            part = word[: -len(suffix)]
            if _measure(part) > 1 and (suffix != "ion" or part.endswith(("s", "t"))):
                word = part
            break
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or (_measure(part) == 1 and not _short(part)):
            word = part
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
