"""Models behind small interfaces. An encoder, reranker or generator is any object with the methods below; it is made
once per task from a registered name and fed Arrow batches, so a real model loads once where it runs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Encoder(Protocol):
    def encode_texts(self, texts: list[str], batch_size: int) -> np.ndarray: ...

    def encode_images(self, images: list[bytes], batch_size: int) -> np.ndarray: ...

    def close(self) -> None: ...


class Reranker(Protocol):
    def logits(self, pairs: list[tuple[str, str]], batch_size: int) -> np.ndarray: ...

    def close(self) -> None: ...


class Generator(Protocol):
    def generate(self, prompts: list[str], max_new_tokens: int) -> list[str]: ...

    def close(self) -> None: ...


@dataclass(frozen=True)
class ModelConfig:
    """What a model is made from. Text longer than ``max_length`` tokens is cut by the model itself."""

    name: str
    text_batch_size: int = 64
    image_batch_size: int = 64
    dtype: str = "float16"
    device: str = "cpu"
    max_length: int | None = None
    lowercase: bool = False
    max_image_tokens: int | None = None

    @property
    def used_dtype(self) -> str:
        """Half precision needs an accelerator."""
        return self.dtype if self.device.startswith("cuda") else "float32"


class HashEncoder:
    """A stand-in for a trained encoder: hashed character trigrams, the same on every machine."""

    def __init__(self, config: ModelConfig, size: int = 64):
        self.config, self.size = config, size

    def _row(self, data: bytes) -> np.ndarray:
        v = np.zeros(self.size)
        for i in range(max(1, len(data) - 2)):
            h = int.from_bytes(hashlib.blake2b(data[i : i + 3], digest_size=8).digest(), "big")
            v[h % self.size] += 1.0 if h & (1 << 40) else -1.0
        return v

    def _unit(self, rows: list[np.ndarray]) -> np.ndarray:
        m = np.array(rows).reshape(-1, self.size)
        return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def encode_texts(self, texts: list[str], batch_size: int) -> np.ndarray:
        return self._unit([self._row((t.lower() if self.config.lowercase else t).encode()) for t in texts])

    def encode_images(self, images: list[bytes], batch_size: int) -> np.ndarray:
        return self._unit([self._row(x) for x in images])

    def close(self) -> None:
        pass


class OverlapReranker:
    """A stand-in for a cross-encoder: the logit is the number of different characters both texts have, less two."""

    def __init__(self, config: ModelConfig):
        self.config = config

    def logits(self, pairs: list[tuple[str, str]], batch_size: int) -> np.ndarray:
        return np.array([len(set(q) & set(d)) - 2.0 for q, d in pairs], float)

    def close(self) -> None:
        pass


class EchoGenerator:
    """A stand-in for a language model: the prompt's first characters."""

    def __init__(self, config: ModelConfig):
        self.config = config

    def generate(self, prompts: list[str], max_new_tokens: int) -> list[str]:
        return [p[: 4 * max_new_tokens].strip() for p in prompts]

    def close(self) -> None:
        pass


class LengthJudge:
    """A stand-in for a model that ranks: the five longest documents of a judge's prompt, the earlier of equals first, the rest filtered."""

    def __init__(self, config: ModelConfig):
        self.config = config

    def generate(self, prompts: list[str], max_new_tokens: int) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        # Numbers and documents by turns, behind what stands before the first document.
        parts = re.split(r"\n\nDocID: (\d+)\n", prompt)[1:]
        order = sorted(zip(map(int, parts[::2]), parts[1::2], strict=True), key=lambda d: (-len(d[1]), d[0]))
        ids = [n for n, _ in order]
        return f"Here you are:\n{json.dumps({'ranked_doc_ids': ids[:5], 'filtered_doc_ids': sorted(ids[5:])})}"

    def close(self) -> None:
        pass


#: Encoders by name; the sizes and limits are those of the public models the names stand for.
ENCODERS: dict[str, Callable[[ModelConfig], Encoder]] = {n: HashEncoder for n in ("clip", "chinese_clip", "siglip2", "gme_2b")}
RERANKERS: dict[str, Callable[[ModelConfig], Reranker]] = {"overlap": OverlapReranker}
GENERATORS: dict[str, Callable[[ModelConfig], Generator]] = {"echo": EchoGenerator, "longest": LengthJudge}
PRESETS = {
    "clip": ModelConfig("clip", max_length=77),
    "chinese_clip": ModelConfig("chinese_clip", max_length=52),
    "siglip2": ModelConfig("siglip2", max_length=64, lowercase=True),
    "gme_2b": ModelConfig("gme_2b", text_batch_size=48, image_batch_size=32, max_image_tokens=64),
}


def build(kind: dict[str, Callable], config: ModelConfig):
    """The model of a registered name."""
    if config.name not in kind:
        raise ValueError(f"no model {config.name!r}; one of {sorted(kind)}")
    return kind[config.name](config)


def encode(df: DataFrame, key: str, text: str, config: ModelConfig) -> DataFrame:
    """``key, vector``: unit vectors of a text column; a null text has a null vector."""
    make = ENCODERS.get(config.name) or build(ENCODERS, config)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make(config)
        for s in parts:
            vectors = iter(model.encode_texts(s[s.notna()].tolist(), config.text_batch_size))
            yield pd.Series([next(vectors) if known else None for known in s.notna()], index=s.index, dtype=object)
        model.close()

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.select(key, F.pandas_udf(run, T.ArrayType(T.FloatType()))(text).alias("vector"))


def pair_score(query: Column, document: Column, config: ModelConfig, batch_size: int = 8) -> Column:
    """Relevance of a document to a query in 0..1: the sigmoid of a cross-encoder's logit. Null where either is."""
    make = RERANKERS.get(config.name) or build(RERANKERS, config)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make(config)
        for q, d in parts:
            out = pd.Series(np.nan, index=q.index)
            known = q.notna() & d.notna()
            out[known] = 1.0 / (1.0 + np.exp(-model.logits(list(zip(q[known], d[known], strict=True)), batch_size)))
            yield out.where(known, None)
        model.close()

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())(query, document)


def generated(prompt: Column, config: ModelConfig, max_new_tokens: int = 256, batch_size: int = 8) -> Column:
    """``value, error`` of a model's answer. Prompts go to the model ``batch_size`` at a time; those of a batch that fails go one by one,
    and what fails alone becomes its row's error. A null prompt has an error."""
    make = GENERATORS.get(config.name) or build(GENERATORS, config)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make(config)

        def answers(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(a, None) for a in model.generate(prompts, max_new_tokens)]
            except Exception as e:  # noqa: BLE001
                return [(None, str(e))] if len(prompts) == 1 else [a for p in prompts for a in answers([p])]

        for s in parts:
            given = s[s.notna()].tolist()
            said = iter([a for at in range(0, len(given), batch_size) for a in answers(given[at : at + batch_size])])
            yield pd.DataFrame([next(said) if known else (None, "no prompt") for known in s.notna()], columns=["value", "error"])
        model.close()

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "value string, error string")(prompt)
