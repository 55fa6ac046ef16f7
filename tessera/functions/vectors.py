"""Vector arithmetic as JVM expressions, and the quantizers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT8_SCALE = 1.0 / 127.0


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has similarity 0 with everything."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def quantize_int8(a: Column, scale: float = INT8_SCALE) -> Column:
    """array<tinyint>: round half to even of x / scale, cut to -127..127."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / F.lit(scale)))).cast("tinyint"))


def int8_cosine(a: Column, b: Column, scale: float = INT8_SCALE) -> Column:
    return cosine(quantize_int8(a, scale), quantize_int8(b, scale))


def hamming(a: Column, b: Column) -> Column:
    """Number of places where the signs (x > 0) differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("int")), F.lit(0), lambda s, x: s + x)


def binary_similarity(distance: Column, dim: Column | int) -> Column:
    """1 - 2 * distance / dim."""
    d = F.lit(dim) if isinstance(dim, int) else dim
    return F.when(d == 0, F.lit(0.0)).otherwise(1.0 - 2.0 * distance / d)


def pack_bits(a: Column) -> Column:
    """Sign bits as hex text, first component in the highest bit; the last byte is filled with zeros."""
    nibbles = F.sequence(F.lit(0), (F.ceil(F.size(a) / 8) * 2 - 1).cast("int"))
    bit = lambda i, w: F.when((i < F.size(a)) & (F.try_element_at(a, i + 1) > 0), F.lit(w)).otherwise(F.lit(0))
    digit = lambda n: F.lower(F.hex((bit(n * 4, 8) + bit(n * 4 + 1, 4) + bit(n * 4 + 2, 2) + bit(n * 4 + 3, 1)).cast("long")))
    return F.array_join(F.transform(nibbles, digit), "")


def calibrate_scale(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row, ``scale``: the largest absolute component / 127, or 1e-8 if that is zero."""
    top = F.max(F.aggregate(column, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double")))))
    return vectors.agg(F.greatest(F.coalesce(top, F.lit(0.0)) / 127.0, F.lit(0.0)).alias("s")).select(F.when(F.col("s") == 0, F.lit(1e-8)).otherwise(F.col("s")).alias("scale"))


class HashingEmbedder:
    """A deterministic offline embedder: signed hashed words, unit length.

    Any object with ``name``, ``revision``, ``dimension``, ``encode_documents``
    and ``encode_query`` serves in its place.
    """

    def __init__(self, dimension: int = 256, name: str = "hashing", revision: str = "1"):
        self.name, self.revision, self.dimension = name, revision, dimension

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        import zlib

        from .text import stem_tokens

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for w in stem_tokens(text) or [""]:
                h = zlib.crc32(w.encode())
                row[h % self.dimension] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
            else:
                row[0] = 1.0
        return out

    def encode_query(self, text: str) -> np.ndarray:
        return self.encode_documents([text])[0]


def compose_embed_text(title: Column, body: Column) -> Column:
    """Trimmed title and body, joined by a line break; empty parts are left out."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws("\n", part(title), part(body))


#: embedders a Python worker has made, by their identity
_MADE: dict[tuple, object] = {}


class ModelEmbedder:
    """An adapter for a real model: ``load`` makes it, once in each Python worker, and only its name travels with a task.

    ``load`` takes no argument and returns a function from texts to a matrix;
    it must be importable on the workers. ``query_prefix`` and
    ``document_prefix`` serve models that tell the two apart.
    """

    def __init__(self, load, name: str, revision: str, dimension: int, query_prefix: str = "", document_prefix: str = ""):
        self.load, self.name, self.revision, self.dimension = load, name, revision, dimension
        self.query_prefix, self.document_prefix = query_prefix, document_prefix

    def _encode(self, texts: list[str]) -> np.ndarray:
        key = (self.name, self.revision, self.dimension)
        if key not in _MADE:
            _MADE[key] = self.load()
        out = np.asarray(_MADE[key](texts), np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        return self._encode([self.document_prefix + t for t in texts])

    def encode_query(self, text: str) -> np.ndarray:
        return self._encode([self.query_prefix + text])[0]


def embed(df: DataFrame, embedder, text_col: str, out_col: str = "embedding") -> DataFrame:
    """Add the vectors of a text column; each Python worker encodes whole Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        got = np.asarray(embedder.encode_documents(texts.fillna("").tolist()), np.float32)
        if got.shape != (len(texts), embedder.dimension) or not np.isfinite(got).all() or (len(got) and (np.linalg.norm(got, axis=1) == 0).any()):
            raise ValueError("the embedder must give one finite, non-zero vector of its dimension for each text")
        return pd.Series(list(got))

    return df.withColumn(out_col, run(F.col(text_col)))
