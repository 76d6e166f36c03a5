"""English words with two pronunciations: a label by the word before, and its IPA in the text."""

from __future__ import annotations

from collections.abc import Mapping

from voxweave.functions.dialect import Spark, lit

PIECES = "[A-Za-z]+|[^A-Za-z]+"
NAMED = ("a", "an", "the", "is", "are", "was", "were", "be", "very", "so", "too")
DONE = ("have", "has", "had", "was", "were", "been", "be", "is", "are", "already", "just")
#: Word -> label -> IPA (public dictionary pronunciations).
TARGETS = {"live": {"V": "lɪv", "J": "laɪv"}, "close": {"V": "kloʊz", "J": "kloʊs"}, "read": {"V": "riːd", "P": "rɛd"}, "tear": {"V": "tɛr", "N": "tɪr"}, "wind": {"V": "waɪnd", "N": "wɪnd"}}
#: Word -> the label after one of these words, and the label elsewhere (rules of our own; a model's labels can be given in their place).
CUES = {"live": ("J", NAMED, "V"), "close": ("J", NAMED, "V"), "read": ("P", DONE, "V"), "tear": ("N", NAMED, "V"), "wind": ("N", NAMED, "V")}


def label(d: Spark, word: str, before: str) -> str:
    """The label of a word in lower case, given the word before it; null for words that are not targets."""
    whens = " ".join(f"when {lit(w)} then case when {before} in ({', '.join(map(lit, after))}) then '{yes}' else '{no}' end" for w, (yes, after, no) in CUES.items())
    return f"case {word} {whens} end"


def heteronyms(d: Spark, x: str, to_ipa: bool = False, to_ssml: bool = False, targets: Mapping[str, Mapping[str, str]] = TARGETS) -> str:
    """x with each target word's IPA in its place, or in a phoneme tag around it; with neither, x as it is.

    Words are runs of A-Z and a-z; a word's label is NONE, and it stays, where the targets have no IPA for it.
    """
    if not (to_ipa or to_ssml):
        return x
    before = f"case when k > 2 then lower({d.at('a', 'greatest(k - 2, 1)')}) else '' end"
    sound = "case concat(lower(p.w), ' ', coalesce(p.l, '')) " + " ".join(f"when {lit(w + ' ' + k)} then {lit(v)}" for w, own in targets.items() for k, v in own.items()) + " end"
    tag = f"concat('<phoneme alphabet=\"ipa\" ph=\"', {sound}, '\">', p.w, '</phoneme>')"
    pairs = d.map(d.upto(d.size("a")), "k", d.struct(w=d.at("a", "k"), l=label(d, f"lower({d.at('a', 'k')})", before)))
    whole = d.join(d.map(pairs, "p", f"coalesce({tag if to_ssml else sound}, p.w)"), "")
    return d.let("a", d.find(x, PIECES), f"case when {d.size('a')} = 0 then {x} else {whole} end")
