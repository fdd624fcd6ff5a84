"""Thai kernels: phonetic form, syllables, romanisation, consonant skeletons. Plain Python, one string at a time."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from .vocabulary import CLUSTERS, FINALS, INITIALS, SOUND_CLASSES, VOWELS

_LEAD = "[เแโใไ]"
_CONS = "[ก-ฮ]"
_MARK = "[ัิ-ู็ะาำๅ]"
_TONE = "[่-๋]"
_PAIR = "(?:" + "|".join(CLUSTERS) + ")"

_THAI = re.compile("[฀-๿]")


def _spread(classes: dict[str, str]) -> dict[str, str]:
    return {c: name for name, chars in classes.items() for c in chars}


_SOUND, _INITIAL, _VOWEL, _FINAL = map(_spread, (SOUND_CLASSES, INITIALS, VOWELS, FINALS))


def contains_thai(text: str) -> bool:
    return _THAI.search(text) is not None


_PHONETIC = re.compile(f"{_LEAD}(?P<after>{_CONS})|(?P<ai>ใ)|(?P<ran>รร)|(?P<drop>[เแโไ]|{_TONE}|[ัิ-ู็])|(?P<cons>{_CONS})")
#: A silencing mark takes the letter before it if that is still Thai: only letters without a sound class are.
_SILENT = re.compile("[ฤฦ]์")


def phonetic_form(text: str) -> str:
    """Consonants by sound class; written-before vowels, tones and vowel marks go, other characters stay."""

    def sound(m: re.Match) -> str:
        if m["ai"]:
            return "ไ"
        if m["ran"]:
            return "n"
        if m["drop"]:
            return ""
        c = m["after"] or m["cons"]
        return _SOUND.get(c, c)

    out = _PHONETIC.sub(sound, text)
    while _SILENT.search(out):
        out = _SILENT.sub("", out)
    return out.replace("์", "")


class Syllable(NamedTuple):
    text: str
    initial: str = ""
    vowel: str = ""
    final: str = ""
    tone: str = ""


#: A pair starts a syllable only before a vowel; a consonant closes one unless a vowel follows it or it begins a pair.
_SYLLABLE = re.compile(
    f"(?P<lead>{_LEAD}*)(?P<initial>{_PAIR}(?={_MARK})|{_CONS})?(?P<marks>(?:ัว|{_MARK})*)"
    f"(?P<final>(?!{_PAIR}){_CONS}(?!{_MARK})(?P<silent>์)?)?(?P<tone>{_TONE}*)"
)
_OTHER = re.compile("[^฀-๿]+")


def syllables(text: str) -> list[Syllable]:
    """Syllables from left to right; a run without Thai is one, a stray mark is one too."""
    out, at = [], 0
    while at < len(text):
        if other := _OTHER.match(text, at):
            out.append(Syllable(other[0]))
            at = other.end()
            continue
        m = _SYLLABLE.match(text, at)
        end = m.end() if m.end() > at else at + 1
        final = "" if m["silent"] else (m["final"] or "")
        out.append(Syllable(text[at:end], m["initial"] or "", m["lead"] + m["marks"], final, m["tone"]))
        at = end
    return out


def _vowel_sound(vowel: str) -> str:
    if "ั" in vowel and "ว" in vowel:
        return "ua"
    return next((_VOWEL[c] for c in vowel if c in _VOWEL), "")


def romanize(text: str) -> str:
    """Romanisation by syllable: initial, written vowel or else o before a final and a without one, final."""
    out = []
    for s in syllables(text):
        if not (s.initial or s.vowel or s.final):
            out.append(s.text.lower())
            continue
        vowel = _vowel_sound(s.vowel) if s.vowel else ("o" if s.final else "a")
        out.append("".join(_INITIAL.get(c, "") for c in s.initial) + vowel + _FINAL.get(s.final, ""))
    return "".join(out)


_FOLDS = str.maketrans({"j": "ch", "v": "w"})


def comparison_form(text: str) -> str:
    """Lower case, with letters that romanisation never has folded to those it has."""
    return text.lower().translate(_FOLDS)


def _letter(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


_REST = {i: None for i in range(128) if not _letter(chr(i))}
_VOWELS = str.maketrans("", "", "aeiou")


def skeleton(text: str) -> str:
    """Consonants of a romanised or Latin text, and a vowel only at the start."""
    text = text.lower()
    kept = text.translate(_REST) if text.isascii() else "".join(filter(_letter, text))
    return (kept[:1] + kept[1:].translate(_VOWELS)).translate(_FOLDS)


_SPOKEN = re.compile("[ัิ-ฺ็-์ะาำเ-ๆ]")


def phonetic_key(form: str, text: str) -> str:
    """The first 8 of the letters and digits of the phonetic form, or else of the text, without vowels after the first letter."""
    out: list[str] = []
    for c in form or text:
        if _letter(c) and not _SPOKEN.match(c) and not (out and c.lower() in "aeiou"):
            out.append(c)
            if len(out) == 8:
                break
    return "".join(out)


@lru_cache(maxsize=200_000)
def spoken(token: str) -> str:
    """The romanised token as parts are compared."""
    return comparison_form(romanize(token))


def parts_score(a: list[str], b: list[str], similarity) -> float:
    """Similarity of romanised names part by part: the worst part counts; different numbers of parts are compared as one string."""
    if not a or not b:
        return 0.0
    left, right = ([spoken(t) for t in tokens] for tokens in (a, b))
    if len(left) != len(right):
        return similarity(" ".join(left), " ".join(right))
    return min(1.0, *(similarity(x, y) for x, y in zip(left, right, strict=True)))
