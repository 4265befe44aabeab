"""Porter's suffix-stripping stemmer (Program, 1980), with the small set of
departures that ROUGE's stemmed mode is usually computed with.

Only called for the distinct tokens of a batch.
"""

from __future__ import annotations

# Irregular forms taken as they are.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix tables of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _consonants(word: str) -> list[bool]:
    marks: list[bool] = []
    for i, ch in enumerate(word):
        if ch == "y":
            marks.append(i == 0 or not marks[-1])
        else:
            marks.append(ch not in "aeiou")
    return marks


def _measure(stem: str) -> int:
    marks = _consonants(stem)
    return sum(1 for before, after in zip(marks, marks[1:]) if after and not before)


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double_consonant(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _consonants(word)[-1]


def _short_end(word: str) -> bool:
    """Consonant-vowel-consonant, the last not w, x or y; or a two-letter vowel-consonant."""
    marks = _consonants(word)
    if len(word) == 2:
        return not marks[0] and marks[1]
    return len(word) >= 3 and marks[-3:] == [True, False, True] and word[-1] not in "wxy"


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
            stem = word[: -len(suffix)]
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            if _measure(stem) == 1 and _short_end(stem):
                return stem + "e"
            return stem
    return word


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _consonants(word)[-2]:
        return word[:-1] + "i"
    return word


def _derivation(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derivation(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix, short in STEP2:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + short if _measure(stem) > 0 else word
    return word


def _adjective(word: str) -> str:
    for suffix, short in STEP3:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + short if _measure(stem) > 0 else word
    return word


_STEP4_LONGEST_FIRST = sorted(STEP4, key=len, reverse=True)


def _residue(word: str) -> str:
    for suffix in _STEP4_LONGEST_FIRST:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if allowed else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _derivation, _adjective, _residue, _tidy):
        word = step(word)
    return word


def rouge_stem(token: str) -> str:
    """ROUGE leaves tokens of up to three characters alone."""
    return stem(token) if len(token) > 3 else token
