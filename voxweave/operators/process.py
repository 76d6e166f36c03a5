"""The front end over a table: normalized text, phonology and pauses of every text, by options."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.functions import english, japanese, kana, scripts, text
from voxweave.functions.dialect import SPARK as D
from voxweave.functions.phonology import lengthened, phonology
from voxweave.operators.providers import Provider, annotate
from voxweave.operators.transliterate import transliterate

WORDS = "[^ \\t\\n\\r]+"
PRESETS = ("custom", "ssml", "raw")
OPTIONS = {"to_ssml": False, "to_ipa": False, "to_json": True, "tn_only": False, "script": "katakana", "preset": "custom", "vowel_length": False, "pitch_accent": False, "read_latin": True}
#: Keys of a result that only models fill; they are empty arrays without a provider.
UNFILLED = ("annotations", "numbers", "morphemes", "heteronym", "counter")


def merge(defaults: Mapping, *overrides: Mapping | None) -> dict:
    """Options with later ones before earlier; a null value overrides nothing, an unknown key is an error."""
    out = dict(defaults)
    for own in overrides:
        for k, v in (own or {}).items():
            if k not in defaults:
                raise ValueError(f"unknown option {k}")
            if v is not None:
                out[k] = v
    return out


def normalized(lang: str, x: str, pitch: bool = False) -> str:
    if lang == "ko":
        return text.normalize_ko(D, x)
    if lang == "ja":
        return japanese.normalize_ja(D, x, pitch=pitch)
    return text.whitespace(D, text.symbols(D, x).replace(" 퍼센트", " percent").replace(" 앤드 ", " and ")) if lang == "en" else x


def spoken(lang: str, x: str, options: Mapping) -> str:
    """SQL of the phonology of normalized text; null for a language without rules."""
    if lang == "ko":
        heard = phonology(D, x)
        if options["vowel_length"]:
            heard = f"array_join(zip_with({D.find(x, WORDS)}, {D.find(heard, WORDS)}, (w, h) -> {lengthened(D, 'w', 'h')}), ' ')"
        if not options["to_ipa"]:
            return heard
        return f"replace({scripts.ipa(D, heard)}, ':', 'ː')" if options["vowel_length"] else scripts.ipa(D, heard)
    if lang == "ja":
        katakana = f"translate({x}, '{scripts.HIRAGANA}', '{scripts.KATAKANA}')"
        if options["to_ipa"]:
            return kana.ipa(D, katakana)
        return {"katakana": katakana, "hiragana": f"translate({katakana}, '{scripts.KATAKANA}', '{scripts.HIRAGANA}')", "romaji": kana.romaji(D, katakana)}[options["script"]]
    return english.heteronyms(D, x, to_ipa=options["to_ipa"] and not options["to_ssml"]) if lang == "en" else "cast(null as string)"


def _marked(heard: str, marks: Mapping[str, str], word: str, restore: bool = False) -> str:
    """Each word with its pause's mark. Tiers go by the normalized word, marks follow the spoken one; restore puts a stop where a sentence ends without a mark."""
    if restore:
        word = f"concat({word}, case when {D.at('_tiers', 'i + 1')} = 'P3' and not x rlike '[.!?]$' then '.' else '' end)"
    case = " ".join(f"when {D.at('_tiers', 'i + 1')} = '{k}' then '{v}'" for k, v in marks.items())
    return f"array_join(transform({D.find(heard, WORDS)}, (x, i) -> concat({word}, case {case} else '' end)), ' ')"


def process(df: DataFrame, column: str, lang: str, options: Mapping | None = None, out: str = "result", provider: Provider | None = None, chunk: int = 32) -> DataFrame:
    """df with `out`: a struct of eight keys, or plain text if to_json is false.

    An unsupported language passes the text through: its phonology is null and it has no pauses. Null
    gives null text; empty text has no pauses. tn_only stops after normalization. A provider fills the keys
    that models fill, with spans of the given text, from `chunk` texts at once; without one they are empty. Korean text has its Latin words read
    in Hangul unless read_latin is false; the raw preset restores stops at the ends of sentences.
    """
    o = merge(OPTIONS, options)
    if o["preset"] not in PRESETS or o["script"] not in ("katakana", "hiragana", "romaji"):
        raise ValueError(f"unknown preset {o['preset']} or script {o['script']}")
    made = df.withColumn("_normal", F.expr(normalized(lang, f"`{column}`", o["pitch_accent"])))
    if lang == "ko" and o["read_latin"]:
        made = made.withColumn("_normal", transliterate("_normal"))
    made = made.withColumn("_heard", F.expr("cast(null as string)" if o["tn_only"] else spoken(lang, "_normal", o)))
    known = lang in ("ko", "ja", "en")
    tiers = f"transform({D.find('_normal', WORDS)}, x -> {text.pause(D, 'x')})" if known and not o["tn_only"] else "cast(array() as array<string>)"
    made = made.withColumn("_tiers", F.expr(tiers))
    if o["to_ssml"] or o["preset"] == "ssml":
        heard = f"concat('<speak>', {_marked('_heard', {k: f' <break strength="{v}"/>' for k, v in text.BREAKS.items()}, text.xml('x'))}, '</speak>')"
        if lang == "en":
            heard = english.heteronyms(D, heard, to_ssml=True)
    elif o["preset"] == "raw":
        heard = _marked("_heard", {k: f"[{k}]" for k in text.PAUSE_MS}, "x", restore=True)
    else:
        heard = "_heard"
    if not o["to_json"]:
        return made.withColumn(out, F.expr(f"coalesce({heard}, _normal)")).drop("_normal", "_heard", "_tiers")
    spots = f"filter(transform({D.find('_heard', WORDS)}, (x, i) -> named_struct('word_idx', i, 'word', x, 'pause', element_at(_tiers, i + 1))), p -> p.pause <> 'NONE')"
    if provider:
        made = annotate(made, column, provider, chunk=chunk, prefix="_head_")
        empty = ", ".join(f"'{k}', _head_{k}" for k in UNFILLED)
    else:
        empty = ", ".join(f"'{k}', cast(array() as array<string>)" for k in UNFILLED)
    return made.withColumn(out, F.expr(f"named_struct('normalized_text', _normal, 'phonology', {heard}, 'pauses', coalesce({spots}, array()), {empty})")).drop("_normal", "_heard", "_tiers", *(f"_head_{k}" for k in UNFILLED))
