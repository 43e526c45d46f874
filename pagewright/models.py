"""Model interfaces, and offline stand-ins so that everything runs without a network.

Embedders work on lists of texts and are created once per task; captioners and generators are plain callables.
"""

import re
import zlib
from typing import Protocol

import numpy as np

from pagewright.rules import COMPOUND_TOKEN, STANDARD_TOKEN

# ---- prompts ---------------------------------------------------------------------------------------
# "Not found in available documents." is a fixed value; the rest is this engine's own wording.
ANSWER_INSTRUCTIONS = """The numbered passages below were retrieved for the question that follows them. Write the answer
that they support, and mark every claim with the passage it rests on, like [2]. Keep numbers, command names and
identifiers exactly as printed. If the passages do not answer the question, reply only: "Not found in available documents."
"""

CAPTION_REQUEST = """You index figures of a technical archive. Read the picture, then the page text given with it, and
write a short paragraph of search terms in running prose: what is drawn, every legible label and value, and how the page
text refers to it. Leave out whatever neither of the two shows.

Paragraph:"""


class Embedder(Protocol):
    dimension: int
    batch_size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Captioner(Protocol):
    def __call__(self, content: bytes, prompt: str) -> str: ...


class Generator(Protocol):
    def __call__(self, question: str, context: str) -> str: ...


#: What every compound token holds; texts without one are not searched for compounds.
_INNER = re.compile(r"[/.](?<=[a-z0-9][/.])[a-z0-9]")


class HashingEmbedder:
    """Signed token hashing to unit vectors: deterministic, no model file, same result on every worker."""

    batch_size = 1024

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        codes, counts = [], []
        for text in texts:
            low = (text or "").lower()
            tokens = set(re.findall(STANDARD_TOKEN, low))
            if _INNER.search(low):
                tokens.update(re.findall(COMPOUND_TOKEN, low))
            codes += [zlib.crc32(token.encode()) for token in tokens]
            counts.append(len(tokens))
        code, row = np.array(codes, dtype=np.int64), np.repeat(np.arange(len(texts)), counts)
        sums = np.bincount(row * self.dimension + (code >> 1) % self.dimension, np.where(code & 1, 1.0, -1.0), len(texts) * self.dimension)
        out = sums.reshape(len(texts), self.dimension).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


class SentenceModelEmbedder:
    """A sentence-transformers model, normalised; half precision on a GPU. Needs the optional package."""

    def __init__(self, name: str = "BAAI/bge-m3"):
        self.name, self._model, self.batch_size, self.dimension = name, None, 16, 1024

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            import torch
            from sentence_transformers import SentenceTransformer
            gpu = torch.cuda.is_available()
            self._model = SentenceTransformer(self.name, device="cuda" if gpu else "cpu")
            if gpu:
                self._model.half()
                self.batch_size = 128
        return self._model.encode(texts, batch_size=self.batch_size, normalize_embeddings=True,
                                  show_progress_bar=False)

    def __getstate__(self):
        return {**self.__dict__, "_model": None}


def local_chat(model: str = "qwen2.5:7b-instruct"):
    """Answers from a local Ollama model. Needs the optional package."""
    def generate(question: str, context: str) -> str:
        import ollama
        reply = ollama.chat(model=model, options={"num_ctx": 8192}, messages=[
            {"role": "system", "content": ANSWER_INSTRUCTIONS},
            {"role": "user", "content": f"Context:\n{context}\n\nQuestion: {question}"}])
        return reply["message"]["content"]

    return generate


def local_vision(model: str = "qwen2.5vl"):
    """Captions from a local Ollama vision model. Needs the optional package."""
    def caption(content: bytes, prompt: str) -> str:
        import ollama
        reply = ollama.chat(model=model, options={"num_ctx": 8192},
                            messages=[{"role": "user", "content": prompt, "images": [content]}])
        return reply["message"]["content"]

    return caption
