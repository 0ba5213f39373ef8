"""Trained models behind the interfaces of ``models``, for machines that have the libraries and the weights.

Nothing here is imported before a model is made, on the executor that runs it. ``register`` adds the names.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

import numpy as np

from shelfmark.models import ENCODERS, RERANKERS, ModelConfig

# Where a library's output may hold the features, in order of preference.
FEATURES = ("image_embeds", "text_embeds", "pooler_output", "last_hidden_state")


def features(output):
    """The features in what a model returns: a tensor as it is, else the first field that is filled."""
    if hasattr(output, "shape"):
        return output
    for name in FEATURES:
        if (held := getattr(output, name, None)) is not None:
            return held
    raise TypeError(f"no features in {type(output).__name__}")


def fetch(files: list[str], folder: str, transport: Callable[[str], bytes]) -> str:
    """Files of a model, one after another; what is there already isn't fetched again, and a file appears only when it is whole."""
    for name in files:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".part", "wb") as f:
            f.write(transport(name))
        os.replace(path + ".part", path)
    return folder


def device(wanted: str | None = None) -> str:
    """The device asked for, else an accelerator if the library finds one, else the processor."""
    if wanted:
        return wanted
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


class HubEncoder:
    """Text and images through a two-tower model in a local folder."""

    def __init__(self, folder: str, config: ModelConfig):
        import torch
        from transformers import AutoModel, AutoProcessor

        self.torch, self.config = torch, config
        self.model = AutoModel.from_pretrained(folder, torch_dtype=getattr(torch, config.used_dtype)).to(config.device).eval()
        self.processor = AutoProcessor.from_pretrained(folder)

    def _encode(self, parts: list, batch_size: int, read, run) -> np.ndarray:
        out = []
        with self.torch.inference_mode():
            for at in range(0, len(parts), batch_size):
                held = read(parts[at : at + batch_size]).to(self.config.device)
                v = features(run(**held)).float()
                out.append((v / v.norm(dim=-1, keepdim=True).clamp_min(1e-12)).cpu().numpy())
        return np.concatenate(out) if out else np.zeros((0, 0), np.float32)

    def encode_texts(self, texts: list[str], batch_size: int) -> np.ndarray:
        cut = {"padding": "max_length", "max_length": self.config.max_length} if self.config.max_length else {"padding": True}
        read = lambda t: self.processor(text=[x.lower() if self.config.lowercase else x for x in t], truncation=True, return_tensors="pt", **cut)
        return self._encode(texts, batch_size, read, self.model.get_text_features)

    def encode_images(self, images: list[bytes], batch_size: int) -> np.ndarray:
        from PIL import Image

        read = lambda x: self.processor(images=[Image.open(io.BytesIO(b)).convert("RGB") for b in x], return_tensors="pt")
        return self._encode(images, batch_size, read, self.model.get_image_features)

    def close(self) -> None:
        del self.model
        if self.config.device.startswith("cuda"):
            self.torch.cuda.empty_cache()


class HubReranker:
    """Pairs through a cross-encoder in a local folder."""

    def __init__(self, folder: str, config: ModelConfig):
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        self.torch, self.config = torch, config
        self.tokens = AutoTokenizer.from_pretrained(folder)
        self.model = AutoModelForSequenceClassification.from_pretrained(folder, torch_dtype=getattr(torch, config.used_dtype)).to(config.device).eval()

    def logits(self, pairs: list[tuple[str, str]], batch_size: int) -> np.ndarray:
        out = []
        with self.torch.inference_mode():
            for at in range(0, len(pairs), batch_size):
                held = self.tokens([list(p) for p in pairs[at : at + batch_size]], padding=True, truncation=True, max_length=self.config.max_length or 512, return_tensors="pt")
                out.append(self.model(**held.to(self.config.device)).logits.view(-1).float().cpu().numpy())
        return np.concatenate(out) if out else np.zeros(0)

    def close(self) -> None:
        del self.model


def register(kind: str, name: str, folder: str) -> None:
    """Makes the model in a folder, which every executor must see, the one of that name."""
    made, held = {"encoder": (HubEncoder, ENCODERS), "reranker": (HubReranker, RERANKERS)}[kind]
    held[name] = lambda config: made(folder, config)
