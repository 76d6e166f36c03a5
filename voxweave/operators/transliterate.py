"""Latin words to Hangul where no dictionary knows them: readable words by sound, others letter by letter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxweave.functions.scripts import FINAL, INITIAL, LETTER_NAMES, MEDIAL

#: Spellings and the sounds they stand for; the longest is taken first (rules of our own).
VOWELS = {"eo": "ㅓ", "oo": "ㅜ", "ee": "ㅣ", "ea": "ㅣ", "ai": "ㅔㅣ", "ay": "ㅔㅣ", "ow": "ㅏㅜ", "ou": "ㅏㅜ", "oi": "ㅗㅣ", "oy": "ㅗㅣ", "au": "ㅗ", "a": "ㅏ", "e": "ㅔ", "i": "ㅣ", "o": "ㅗ", "u": "ㅜ", "y": "ㅣ"}
CONSONANTS = {"sch": "ㅅㅋ", "sh": "ㅅ", "ch": "ㅊ", "th": "ㅅ", "ph": "ㅍ", "ck": "ㅋ", "ng": "ㅇ", "b": "ㅂ", "c": "ㅋ", "d": "ㄷ", "f": "ㅍ", "g": "ㄱ", "h": "ㅎ", "j": "ㅈ", "k": "ㅋ", "l": "ㄹ", "m": "ㅁ", "n": "ㄴ", "p": "ㅍ", "q": "ㅋ", "r": "ㄹ", "s": "ㅅ", "t": "ㅌ", "v": "ㅂ", "w": "ㅇ", "x": "ㅋㅅ", "z": "ㅈ"}
CODAS = {"ㄴ": "ㄴ", "ㄹ": "ㄹ", "ㅁ": "ㅁ", "ㅇ": "ㅇ"}  # heard as finals; stops are too at the end, after a vowel
STOPS = {"ㅂ": "ㅂ", "ㅋ": "ㄱ", "ㅍ": "ㅂ", "ㅌ": "ㅅ", "ㄱ": "ㄱ"}
TOKEN = re.compile("|".join(sorted([*VOWELS, *CONSONANTS], key=lambda k: -len(k))))


def readable(word: str) -> bool:
    """A vowel letter is there, and no more than four consonant letters run on."""
    w = word.lower()
    return bool(re.search("[aeiouy]", w)) and not re.search("[^aeiouy]{5}", w)


def _syllable(i: str, m: str, f: str = "") -> str:
    return chr(44032 + 588 * INITIAL.index(i) + 28 * MEDIAL.index(m) + FINAL.index(f))


def by_sound(word: str) -> str:
    """Hangul of a lower-case word by its letters' sounds; consonants without a vowel take ㅡ or end a syllable."""
    w = re.sub(r"([bcdfghj-np-tv-z])\1", r"\1", word)
    w = re.sub(r"(?<=[aeiouy][bcdfghj-np-tv-z])e$|(?<=[bcdfgkpt]l)e$", "", w)  # a silent e
    w = re.sub(r"(?<=[aiouy])r(?![aeiouy])", "", re.sub(r"er(?![aeiouy])", "eo", w))
    sounds: list[tuple[bool, str]] = []
    for t in TOKEN.findall(w):
        sounds += [(t in VOWELS, x) for x in VOWELS.get(t) or CONSONANTS[t]]
    out: list[list[str]] = []
    for k, (vowel, x) in enumerate(sounds):
        after = sounds[k + 1 : k + 2]
        if vowel:
            lead = sounds[k - 1][1] if k and not sounds[k - 1][0] else "ㅇ"
            out.append([lead, x, ""])
        elif after and after[0][0]:
            if x == "ㄹ" and out and out[-1][2] == "" and k and sounds[k - 1][0] and "l" in w:
                out[-1][2] = "ㄹ"
        elif out and not after and x == "ㄹ" and out[-1][1:] == ["ㅡ", ""]:
            out[-1][2] = x
        elif out and not out[-1][2] and k and sounds[k - 1][0] and (x in CODAS or x in STOPS and not after):
            out[-1][2] = CODAS.get(x) or STOPS[x]
        else:
            out.append([x, "ㅡ", ""])
    return "".join(_syllable(*s) for s in out)


@lru_cache(100_000)
def read_word(word: str) -> str:
    """One word of A-Z and a-z. Capital letters inside it begin parts that are read apart; capitals alone are spelt."""
    parts = re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]", word)
    spelt = lambda p: "".join(LETTER_NAMES[ord(c) - 97] for c in p.lower())
    return "".join(spelt(p) if p.isupper() or not readable(p) else by_sound(p.lower()) for p in parts)


def transliterate(column: Column | str) -> Column:
    """The text with each run of A-Z and a-z read in Hangul; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else re.sub("[A-Za-z]+", lambda m: read_word(m[0]), t))

    return run(column)
