"""Embedders: texts to vectors, a model at a time per worker.

An embedder is a function from rows of element_pk and text to rows of element_pk
and embedding.  ``embedder`` makes one by name; those that need a model of their
own are there only where its library is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[DataFrame], DataFrame]
Batch = Callable[[list[str]], np.ndarray]
DDL = "element_pk bigint, embedding array<float>"


def batched(load: Callable[[], Batch], size: int = 256) -> Embed:
    """An embedder of a function that loads a model (once a task) and gives vectors for lists of texts.

    Null and empty texts get a vector of zeros; vectors are of length 1 or 0.
    """
    schema = pa.schema([("element_pk", pa.int64()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]):
        model = load()
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                texts = [t or "" for t in part.column(1).to_pylist()]
                v = np.asarray(model(texts), dtype=np.float64)
                v[[not t.strip() for t in texts]] = 0
                n = np.linalg.norm(v, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list((v / np.where(n, n, 1)).astype(np.float32)), pa.list_(pa.float32()))], schema=schema)

    return lambda rows: rows.select(F.col("element_pk").cast("long"), "text").mapInArrow(run, DDL)


def _hashing(dimensions: int) -> Callable[[], Batch]:
    def load() -> Batch:
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for i, t in enumerate(texts):
                for w in re.findall(r"\w+", t.lower()):
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                    out[i, h % dimensions] += 1 if h >> 63 else -1
            return out

        return model

    return load


def _sentence_transformer(name: str) -> Callable[[], Batch]:
    def load() -> Batch:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        return lambda texts: model.encode(texts, normalize_embeddings=True)

    return load


def _fastembed(name: str) -> Callable[[], Batch]:
    def load() -> Batch:
        from fastembed import TextEmbedding

        model = TextEmbedding(name)
        return lambda texts: np.array(list(model.embed(texts)))

    return load


def _openai(name: str) -> Callable[[], Batch]:
    def load() -> Batch:
        from openai import OpenAI

        client = OpenAI()
        return lambda texts: np.array([x.embedding for x in client.embeddings.create(model=name, input=[t or " " for t in texts]).data])

    return load


def embedder(provider: str = "huggingface", model: str | None = None, dimensions: int = 256) -> Embed:
    """``hashing`` (signed word hashes, needs no model), ``huggingface``, ``fastembed`` or ``openai``."""
    makers = {
        "hashing": lambda: _hashing(dimensions), "huggingface": lambda: _sentence_transformer(model or "sentence-transformers/all-MiniLM-L6-v2"),
        "fastembed": lambda: _fastembed(model or "BAAI/bge-small-en-v1.5"), "openai": lambda: _openai(model or "text-embedding-3-small"),
    }
    if provider not in makers:
        raise ValueError(f"no such provider: {provider}")
    return batched(makers[provider]())


def plain_texts(elements: DataFrame) -> DataFrame:
    """element_pk, text: the preview of each element that isn't a root and has one."""
    return elements.where("element_type <> 'root' and trim(content_preview) <> ''").select("element_pk", F.col("content_preview").alias("text"))


def query_vector(spark, embed: Embed, text: str) -> list[float]:
    """The vector of one text, made where all others are."""
    return list(embed(spark.createDataFrame([(0, text)], "element_pk long, text string")).first().embedding)
