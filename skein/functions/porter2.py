"""The English stemmer of the Snowball project ("Porter2"), from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"


def _vowel(c: str) -> bool:
    return c in _VOWELS


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else _after_vc(w, 0)
    return r1, _after_vc(w, r1)


def _after_vc(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if not _vowel(w[i]) and _vowel(w[i - 1]):
            return i + 1
    return len(w)


def _ends_short(w: str) -> bool:
    if len(w) >= 3:
        a, b, c = w[-3:]
        return not _vowel(a) and _vowel(b) and not _vowel(c) and c not in "wxY"
    return len(w) == 2 and _vowel(w[0]) and not _vowel(w[1])


@lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word[1:] if word.startswith("'") else word
    if w in _WHOLE:
        return _WHOLE[w]
    if len(w) <= 2:
        return w
    w = _mark_y(w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(_vowel(c) for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    # 1b
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(_vowel(c) for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _ends_short(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w[-2]):
        w = w[:-1] + "i"
    # 2
    found = None
    for s, to in sorted([*_STEP2, ("ogi", "og"), ("li", "")], key=lambda x: -len(x[0])):
        if w.endswith(s):
            found = (s, to)
            break
    if found and len(w) - len(found[0]) >= r1:
        s, to = found
        before = w[: -len(s)]
        if s == "ogi":
            w = before + to if before.endswith("l") else w
        elif s == "li":
            w = before if before and before[-1] in _LI else w
        else:
            w = before + to
    # 3
    for s, to in sorted([*_STEP3, ("ative", "")], key=lambda x: -len(x[0])):
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    # 4
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[:-1].endswith("l"):
        w = w[:-1]
    return w.lower()


def _mark_y(word: str) -> str:
    """y at the start or after a vowel is a consonant, and no vowel for the next letter."""
    out: list[str] = []
    for i, c in enumerate(word):
        out.append("Y" if c == "y" and (i == 0 or _vowel(out[-1])) else c)
    return "".join(out)
