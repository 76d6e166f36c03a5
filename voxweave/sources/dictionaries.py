"""Look-up tables and tokenizer files, read on the driver through Spark's readers, with a checked size."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from voxweave.operators.wordpiece import WordPiece

#: More entries than this do not become part of a plan; join a table of that size instead.
MOST = 50_000


def dictionary(spark: SparkSession, path: str, most: int = MOST) -> dict:
    """The one JSON object of a file, as a dictionary of at most `most` entries. An empty file is an empty dictionary."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"{path} holds more than one file")
    table = json.loads(rows[0][0]) if rows and rows[0][0].strip() else {}
    if not isinstance(table, dict) or len(table) > most:
        raise ValueError(f"{path} is no object of at most {most} entries")
    return table


def readings(spark: SparkSession, path: str, most: int = MOST) -> dict[str, tuple[str, int]]:
    """A Japanese dictionary: {word: reading} or {word: [reading, accent]}; without an accent it is 0."""
    return {k: (v, 0) if isinstance(v, str) else (v[0], int(v[1])) for k, v in dictionary(spark, path, most).items()}


def wordpiece(spark: SparkSession, path: str) -> WordPiece:
    """The tokenizer of a tokenizer JSON file whose model is WordPiece; other models are an error."""
    spec = dictionary(spark, path)
    model, norm = spec.get("model") or {}, spec.get("normalizer") or {}
    if model.get("type", "WordPiece") != "WordPiece":
        raise ValueError(f"the model of {path} is {model['type']}")
    vocab: Mapping[str, int] = model["vocab"]
    special = {"cls": "[CLS]", "sep": "[SEP]", "unk": model.get("unk_token", "[UNK]"), "pad": "[PAD]"}
    ids = {k: vocab[t] for k, t in special.items() if t in vocab}
    return WordPiece(vocab, **ids, lower=norm.get("lowercase", True), split_han=norm.get("handle_chinese_chars", False), most_chars=model.get("max_input_chars_per_word", 100), prefix=model.get("continuing_subword_prefix", "##"))


def one_text(spark: SparkSession, args: Sequence[str] | None = None, default: str = "") -> DataFrame:
    """(value) of one row: the words of a command line, or the default without any."""
    args = sys.argv[1:] if args is None else args
    return spark.createDataFrame([(" ".join(args) if args else default,)], "value string")


def home(explicit: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The folder of assets: the one given, else VOXWEAVE_HOME, else the present folder."""
    env = os.environ if env is None else env
    return explicit or env.get("VOXWEAVE_HOME") or os.getcwd()
