"""Vectors of texts by a pluggable encoder; a hashed bag of words stands in where no model is given."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text as tx
from .review import query_instruction

#: texts to rows of vectors; made once per worker by a factory.
Encode = Callable[[list[str]], np.ndarray]
BATCH = 16
WORDS = re.compile(r"\w+").findall
#: ASCII without what stands between words: cut by spaces, it has the words of the pattern.
APART = bytes(k if k < 128 and re.match(r"\w", chr(k)) else 32 for k in range(256))


def hashed_words(dim: int = 256) -> Encode:
    """A stand-in, not a language model: signed hashes of words, summed."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * dim), np.float32)
        for k, t in enumerate(map(str.lower, texts)):
            words = t.encode().translate(APART).split() if t.isascii() else map(str.encode, WORDS(t))
            h = np.fromiter(map(zlib.crc32, words), np.int64)
            out[k] = np.bincount(h % dim + (h >> 31) * dim, minlength=2 * dim)
        return out[:, dim:] - out[:, :dim]

    return encode


def encode_documents(rows: DataFrame, text_column: str, factory: Callable[[], Encode] = hashed_words, batch: int = BATCH) -> DataFrame:
    """Adds ``v``: float vectors of length one (of nothing: zeros).  The encoder is made once per worker."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in parts:
            found = []
            for k in range(0, len(texts), batch):
                m = encode([t or "" for t in texts.iloc[k : k + batch]])
                found += list((m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)).astype(np.float32))
            yield pd.Series(found, index=texts.index)

    return rows.withColumn("v", encoded(F.col(text_column)))


def encode_query(text: str, model_id: str = "", factory: Callable[[], Encode] = hashed_words, spark=None) -> list[float]:
    """A query's vector, with the words its family of encoders wants before it."""
    prefix = spark.range(1).select(query_instruction(F.lit(model_id)).alias("p")).first()["p"] if spark and model_id else ""
    v = np.asarray(factory()([prefix + text])[0], float)
    return (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()


def text_for_vector(text: Column, body: Column) -> Column:
    """The composed text of a document, or the first 2,000 characters of its body where that is blank."""
    return F.coalesce(tx.blank_to_null(F.trim(text)), F.substring(body, 1, 2000))


def store_name(model_id: Column) -> Column:
    """One store per model: the model's name as a slug."""
    return tx.slug(model_id)
