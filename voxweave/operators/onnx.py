"""A provider whose backbone is an ONNX file, opened once a worker."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark import SparkFiles, TaskContext
from pyspark.sql import SparkSession

from voxweave.operators.providers import Encoded, Model, Provider, RuleProvider
from voxweave.operators.wordpiece import WordPiece
from voxweave.sources import dictionaries
from voxweave.sources.assets import pinned

#: Execution providers by device, and the devices that auto tries in turn.
DEVICES = {"cuda": "CUDAExecutionProvider", "coreml": "CoreMLExecutionProvider", "directml": "DmlExecutionProvider", "openvino": "OpenVINOExecutionProvider"}
AUTO = ("cuda", "coreml", "directml")


def execution(device: str, available: Sequence[str]) -> list:
    """The execution providers to ask for, the CPU's last; a device that is not there leaves the CPU. cuda:1 is the second one."""
    name, _, number = device.lower().partition(":")
    if name not in (*DEVICES, "auto", "cpu"):
        raise ValueError(f"unknown device {device}")
    found = next((DEVICES[x] for x in (AUTO if name == "auto" else (name,)) if DEVICES.get(x) in available), None)
    return [*([(found, {"device_id": number}) if number else found] if found else []), "CPUExecutionProvider"]


@lru_cache(maxsize=4)
def session(path: str, device: str, threads: int):
    """An open file, kept by the worker for its later tasks; a device that fails to open leaves the CPU, with a warning."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
    asked = execution(device, onnxruntime.get_available_providers())
    try:
        return onnxruntime.InferenceSession(path, options, providers=asked)
    except Exception as e:
        if len(asked) == 1:
            raise
        warnings.warn(f"{device} does not open {path}: {e}; the CPU is used", stacklevel=2)
        return onnxruntime.InferenceSession(path, options, providers=asked[-1:])


@dataclass
class OnnxProvider:
    """A backbone with inputs input_ids and, if it names them, attention_mask and token_type_ids; its first output is (texts, tokens, dim).

    path: absolute and there on every executor, or the name of a file that was given to SparkContext.addFile. Windows of one
    length run in one pass of at most `rows`, so nothing is padded, and a text's states do not depend on its neighbours.
    Texts over `most` tokens run in windows of that size, whole. Heads come from another provider.
    """

    path: str
    tokenizer: WordPiece
    rules: Provider = field(default_factory=RuleProvider)
    most: int = 512
    rows: int = 32

    def open(self, device: str, threads: int) -> Model:
        """threads: within an operation; 0 takes the task's cores (spark.task.cpus)."""
        task = TaskContext.get()
        cores = threads or (task.cpus() if task else 1)
        path = self.path if os.path.isabs(self.path) else SparkFiles.get(self.path)
        return _Opened(self, session(path, device, cores), self.rules.open(device, threads))


class _Opened:
    def __init__(self, given: OnnxProvider, opened, rules: Model):
        self.given, self.opened, self.rules = given, opened, rules

    def encode(self, texts: list[str]) -> list[Encoded]:
        coded = [self.given.tokenizer.encode(t) for t in texts]
        by: dict[int, list[tuple[int, int]]] = {}
        for i, (ids, _, _) in enumerate(coded):
            for s in range(0, len(ids), self.given.most):
                by.setdefault(min(self.given.most, len(ids) - s), []).append((i, s))
        made: dict[tuple[int, int], np.ndarray] = {}
        names = [x.name for x in self.opened.get_inputs()]
        for n, own in by.items():
            for a in range(0, len(own), self.given.rows):
                part = own[a : a + self.given.rows]
                ids = np.array([coded[i][0][s : s + n] for i, s in part], np.int64)
                feeds = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
                states = self.opened.run(None, {x: feeds[x] for x in names})[0]
                made.update(zip(part, states.astype(np.float32)))
        out = []
        for i, (ids, starts, ends) in enumerate(coded):
            parts = [made[i, s] for s in range(0, len(ids), self.given.most)]
            out.append(Encoded(np.concatenate(parts) if parts else np.zeros((0, 0), np.float32), starts, ends))
        return out

    def heads(self, text: str, encoded: Encoded) -> Mapping[str, list[tuple[int, int, str, float]]]:
        return self.rules.heads(text, encoded)


def load(spark: SparkSession, lang: str, root: str | None = None, variant: str | None = None, dict_version: str | None = None, model_version: str | None = None) -> tuple[OnnxProvider, dict] | None:
    """The provider and the dictionary of a language's assets, by their active versions or the ones named; None if one is missing.

    Executors get the model's file through Spark, so files of models loaded together need names of their own.
    """
    found = pinned(dictionaries.home(root), lang.lower(), variant, dict_version, model_version)
    if found is None:
        return None
    spark.sparkContext.addFile(str(found.model))
    words = dictionaries.dictionary(spark, found.dictionary.as_uri()) if found.dictionary else {}
    return OnnxProvider(Path(found.model).name, dictionaries.wordpiece(spark, found.tokenizer.as_uri())), words
