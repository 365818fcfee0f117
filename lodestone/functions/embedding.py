"""Embedding providers behind one protocol, applied to a column partition by partition."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.hashing import stub_vector


class Unavailable(RuntimeError):
    """The endpoint can't be reached; a fallback may take over."""


class BadReply(RuntimeError):
    """The endpoint answered, but not with the vectors asked for."""


class Provider(Protocol):
    """U1."""

    name: str
    dimensions: int
    model_id: str

    def embed(self, batch: list[str]) -> list[list[float]]: ...

    def health_check(self) -> None: ...


@dataclass
class Stub:
    """Deterministic vectors without a model."""

    dimensions: int = 8
    name: str = "stub"
    model_id: str = "stub"

    def embed(self, batch: list[str]) -> list[list[float]]:
        return [stub_vector(t, self.dimensions) for t in batch]

    def health_check(self) -> None:
        pass


def in_order(data: list[dict], n: int, width: int) -> list[list[float]]:
    """a reply's vectors by index; each index once, each vector finite and of the right width."""
    out: list[list[float] | None] = [None] * n
    for x in data:
        k = x["index"]
        if not 0 <= k < n or out[k] is not None:
            raise BadReply(f"index {k} of {n} is out of range or repeated")
        v = [float(y) for y in x["embedding"]]
        if len(v) != width or not all(abs(y) < float("inf") for y in v):
            raise BadReply("a vector has the wrong width or is not finite")
        out[k] = v
    if any(v is None for v in out):
        raise BadReply(f"{sum(v is not None for v in out)} vectors for {n} texts")
    return out  # type: ignore[return-value]


def endpoint(url: str) -> str:
    """without white space around it or slashes at its end."""
    return url.strip().rstrip("/")


@dataclass
class Http:
    """An embeddings endpoint; three attempts, waiting 0.2 to 2 s after 429, 5xx and transport errors."""

    endpoint: str
    model_id: str
    dimensions: int
    key: str | None = None
    timeout: float = 8.0
    attempts: int = 3
    name: str = "http"

    def embed(self, batch: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model_id, "input": batch}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        url = endpoint(self.endpoint) + "/v1/embeddings"
        for k in range(self.attempts):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=self.timeout) as r:
                    return in_order(json.load(r)["data"], len(batch), self.dimensions)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise BadReply(f"status {e.code}") from e
                error: Exception = e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                error = e
            if k + 1 < self.attempts:
                time.sleep(min(2.0, 0.2 * 2**k))
        raise Unavailable(str(error))

    def health_check(self) -> None:
        self.embed(["ok"])


@dataclass
class Fallback:
    """The second provider where the first is unavailable; both of one model and width."""

    first: Provider
    second: Provider
    name: str = "fallback"

    def __post_init__(self) -> None:
        if (self.first.model_id, self.first.dimensions) != (self.second.model_id, self.second.dimensions):
            raise ValueError("providers of different models can't stand in for each other")
        self.model_id, self.dimensions = self.first.model_id, self.first.dimensions

    def embed(self, batch: list[str]) -> list[list[float]]:
        try:
            return self.first.embed(batch)
        except Unavailable:
            return self.second.embed(batch)

    def health_check(self) -> None:
        try:
            self.first.health_check()
        except Unavailable:
            self.second.health_check()


def padded(ids: list[list[int]], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """token ids padded on the right to the longest, and the mask of what is not padding."""
    width = max(map(len, ids), default=0)
    out, mask = np.full((len(ids), width), fill, np.int64), np.zeros((len(ids), width), np.int64)
    for k, own in enumerate(ids):
        out[k, : len(own)] = own
        mask[k, : len(own)] = 1
    return out, mask


def checked_output(hidden: np.ndarray, rows: int, width: int) -> np.ndarray:
    """a model's token vectors, if there are as many rows and components as there should be."""
    if hidden.ndim != 3 or hidden.shape[0] != rows or hidden.shape[2] != width:
        raise BadReply(f"the model gave {hidden.shape} for {rows} texts of width {width}")
    return hidden


def unit(x: np.ndarray) -> np.ndarray:
    """rows of length one; a zero row stays zero."""
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros(x.shape), where=n > 0)


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """A unit vector for each text: its first token's, or the mean over its tokens that are no padding."""
    if how == "cls":
        return unit(hidden[:, 0])
    if how != "mean":
        raise ValueError(f"no such pooling: {how}")
    n = np.maximum(mask.sum(1, keepdims=True), 1)
    return unit((hidden * mask[:, :, None]).sum(1) / n)


def verified(path: str, size: int, sha256: str) -> bool:
    """whether a file has this size and digest."""
    if not os.path.isfile(path) or os.path.getsize(path) != size:
        return False
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == sha256


@functools.cache
def _session(folder: str, model_id: str):
    """The tokenizer and the model of a folder, loaded once a process."""
    import onnxruntime
    from tokenizers import Tokenizer

    model, tokens = (f"{folder}/{model_id}{end}" for end in (".onnx", ".tokenizer.json"))
    for path in (model, tokens):
        if not os.path.isfile(path):
            raise Unavailable(f"there is no file {path}")
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return Tokenizer.from_file(tokens), onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


@dataclass
class Model:
    """A model in the workers: ``folder`` holds MODEL.onnx and MODEL.tokenizer.json on every executor.

    Texts longer than ``longest`` tokens are cut there, as the model can't read on; batches are bounded by tokens.
    """

    model_id: str
    dimensions: int
    pooling: str = "cls"
    longest: int = 512
    folder: str = ""
    budget: int = 2048
    name: str = "bundled"

    def embed(self, batch: list[str]) -> list[list[float]]:
        tokenizer, session = _session(self.folder, self.model_id)
        ids = [e.ids[: self.longest] for e in tokenizer.encode_batch(batch)]
        wanted = {i.name for i in session.get_inputs()}
        out: list = [None] * len(batch)
        for rows in sub_batches(list(map(len, ids)), self.budget):
            tokens, mask = padded([ids[k] for k in rows])
            feed = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
            hidden = checked_output(session.run(None, {k: v for k, v in feed.items() if k in wanted})[0], len(rows), self.dimensions)
            for k, v in zip(rows, pooled(hidden, mask, self.pooling).tolist(), strict=True):
                out[k] = v
        return out

    def health_check(self) -> None:
        self.embed(["ok"])


def sub_batches(lengths: list[int], budget: int = 2048) -> list[list[int]]:
    """Rows by length; a batch closes when its longest times its count would pass the budget."""
    out: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        if out and max(lengths[k], 1) * (len(out[-1]) + 1) <= budget:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def embed(text: Column, provider: Provider, batch_size: int = 32) -> Column:
    """A vector for each text; the provider is made ready once a task."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = ["" if t is None else t for t in s]
            out: list = []
            for k in range(0, len(texts), batch_size):
                out += provider.embed(texts[k : k + batch_size])
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)
