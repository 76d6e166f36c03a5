"""The files of a language's model and dictionary, by variant and version."""

from __future__ import annotations

import json
from pathlib import Path
from typing import NamedTuple

PLACES = ("", ".", "models", "..", "../models")


class Assets(NamedTuple):
    variant: str
    model_version: str
    dict_version: str | None
    model: Path
    tokenizer: Path
    dictionary: Path | None


def folder(root: str, lang: str, places: tuple[str, ...] = PLACES) -> Path | None:
    """The first folder, root before the usual places, that holds a model index for lang; None if none does."""
    index = f"{lang.upper()}_model_index.json"
    for place in dict.fromkeys((root, *places)):
        for own in (Path(place) / "models" / lang, Path(place) / lang):
            if place and (own / index).is_file():
                return own
    return None


def pinned(root: str, lang: str, variant: str | None = None, dict_version: str | None = None, model_version: str | None = None, places: tuple[str, ...] = ()) -> Assets | None:
    """The files that the index names for a variant and versions, its active ones where none is named; None if one is missing.

    The index: {"active": {"variant", "model", "dictionary"}, "models": {variant: {version: {"model", "tokenizer"}}},
    "dictionaries": {version: file}}, with files relative to its folder. Without a dictionary named or active there is none.
    """
    own = folder(root, lang, places)
    if own is None:
        return None
    index = json.loads((own / f"{lang.upper()}_model_index.json").read_text())
    active = index.get("active", {})
    variant, model_version, dict_version = variant or active.get("variant"), model_version or active.get("model"), dict_version or active.get("dictionary")
    files = index.get("models", {}).get(variant, {}).get(model_version)
    words = index.get("dictionaries", {}).get(dict_version)
    if files is None or (dict_version and words is None):
        return None
    found = Assets(variant, model_version, dict_version, (own / files["model"]).resolve(), (own / files["tokenizer"]).resolve(), (own / words).resolve() if words else None)
    return found if all(x.is_file() for x in found[3:] if x) else None
