"""Text embeddings: each distinct text once, incrementally, joined back, and optionally reduced by PCA."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.columns import embedding_name, quote
from tabflow.operators.lookup import lookup

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

# Share of the dimensions kept by each compression preset.
PRESETS = {"full": 1.0, "high_quality": 0.95, "balanced": 0.85, "space_efficient": 0.75}


def hashing_embedder(dimensions: int = 16) -> Embedder:
    """Counts of the words by the first hex digits of their MD5, scaled to length 1. Needs no model and no network."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        import hashlib

        slots: dict[str, int] = {}
        out = []
        for text in texts:
            counts = np.zeros(dimensions)
            for word in text.split(" "):
                if word:
                    slot = slots.get(word)
                    if slot is None:
                        slot = slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dimensions
                    counts[slot] += 1
            length = math.sqrt(float(counts @ counts))
            out.append((counts / length if length else counts).tolist())
        return out

    return embed


def text_key(c: Column) -> Column:
    """SHA-256 of the text: joins and stores compare 32 bytes instead of whole texts."""
    return F.unhex(F.sha2(c, 256))


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """text_key, text of the distinct, non-null, non-empty values. Copies are combined in the map tasks.

    Grouped by the key alone: whoever only counts or compares moves no texts, and joins on the key find the texts dealt by it.
    """
    c = F.col(quote(column))
    texts = df.select(c.alias("text")).filter(c.isNotNull() & (c != ""))
    return texts.select(text_key(F.col("text")).alias("text_key"), "text").dropDuplicates(["text_key"])


def embed_texts(texts: DataFrame, embedder: Embedder, batch_rows: int = 500) -> DataFrame:
    """text_key, embedding for a frame of (text_key, text). The embedder gets lists of at most ``batch_rows`` texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                vectors = embedder(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the embedder must return one vector per text")
                yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "embedding": [None if v is None else list(map(float, v)) for v in vectors]})

    return texts.select("text_key", "text").mapInPandas(run, "text_key binary, embedding array<float>")


def embed_column(df: DataFrame, column: str, embedder: Embedder, batch_rows: int = 500) -> DataFrame:
    """Adds ``{column}_embedding``; a vector already in the frame is kept over a new one."""
    vectors = embed_texts(distinct_texts(_needing(df, column), column), embedder, batch_rows)
    return attach(df, column, vectors)


def embed_rows(df: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    """Fills missing vectors row by row, in Arrow batches. For streams, where distinct texts cannot be collected first."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        given = texts.notna() & (texts != "")
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        for i, v in zip(texts.index[given], embedder(texts[given].tolist())):
            out[i] = list(map(float, v))
        return out

    name = embedding_name(column)
    stored = F.col(quote(name)) if name in df.columns else F.lit(None).cast("array<float>")
    vector = F.coalesce(stored, run(F.when(stored.isNull(), F.col(quote(column)))))
    return df.select(*[F.col(quote(c)) for c in df.columns if c != name], vector.alias(name))


def _needing(df: DataFrame, column: str) -> DataFrame:
    name = embedding_name(column)
    return df.filter(F.col(quote(name)).isNull()) if name in df.columns else df


def attach(df: DataFrame, column: str, vectors: DataFrame, name: str | None = None) -> DataFrame:
    """Left join of the vectors on the text. Keys of ``vectors`` are unique, so the number of rows stays."""
    name = name or embedding_name(column)
    found = vectors.select(F.col("text_key").alias("_text_key"), F.col("embedding").alias("_vector"))
    c = F.col(quote(column))
    joined = lookup(df, F.when(c != "", text_key(c)), found, "_text_key")
    vector = F.coalesce(F.col(quote(name)), F.col("_vector")) if name in df.columns else F.col("_vector")
    return joined.select(*[F.col(quote(c)) for c in df.columns if c != name], vector.alias(name))


class EmbeddingStore:
    """Vectors by text, append-only: a stored vector is never replaced. Full and compressed vectors are kept apart."""

    def __init__(self, spark, path: str):
        from tabflow.sources.store import Store

        self.full = Store(spark, f"{path}/full", key="text_key")
        self.compressed = Store(spark, f"{path}/compressed", key="text_key")

    def missing(self, df: DataFrame, column: str) -> DataFrame:
        """Distinct texts of the column without a stored vector."""
        texts = distinct_texts(df, column)
        if self.full.is_empty():
            return texts
        return texts.join(self.full.read().select("text_key"), "text_key", "left_anti")

    def update(self, df: DataFrame, column: str, embedder: Embedder, batch_rows: int = 500) -> None:
        vectors = embed_texts(self.missing(df, column), embedder, batch_rows).filter(F.col("embedding").isNotNull())
        self.full.append_new(vectors)

    def attach(self, df: DataFrame, column: str, compressed: bool = False) -> DataFrame:
        return attach(df, column, (self.compressed if compressed else self.full).read())

    def compress(self, pca: Compressor) -> None:
        """Stores reduced vectors of all texts that have none yet."""
        self.compressed.append_new(pca.transform(self.full.read()))

    def compact(self) -> None:
        self.full.compact()
        if not self.compressed.is_empty():
            self.compressed.compact()


class Compressor:
    """PCA of distinct vectors; fitted on training vectors, applied to all."""

    def __init__(self, dimensions: int | None = None, preset: str | None = None, variance: float | None = None):
        if sum(v is not None for v in (dimensions, preset, variance)) != 1:
            raise ValueError("give one of dimensions, preset and variance")
        if preset is not None and preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}; known: {sorted(PRESETS)}")
        self.dimensions, self.preset, self.variance = dimensions, preset, variance
        self.model = None

    def fit(self, vectors: DataFrame, column: str = "embedding") -> Compressor:
        from pyspark.ml.feature import PCA

        given = vectors.filter(F.col(quote(column)).isNotNull())
        width = given.select(F.size(quote(column)).alias("n")).first()
        if width is None:
            raise ValueError("no vectors to fit on")
        width = width.n
        if self.dimensions is not None:
            k = min(self.dimensions, width)
        elif self.preset is not None:
            k = math.ceil(width * PRESETS[self.preset])
        else:
            k = width
        self.model = PCA(k=k, inputCol="_in", outputCol="_out").fit(_as_vectors(given, column))
        if self.variance is not None:
            reached = np.cumsum(self.model.explainedVariance.toArray())
            k = int(np.searchsorted(reached, self.variance - 1e-12) + 1)
            if k < width:
                self.model = PCA(k=k, inputCol="_in", outputCol="_out").fit(_as_vectors(given, column))
        return self

    @property
    def n_components(self) -> int:
        return self.model.getK()

    @property
    def explained(self) -> float:
        return float(np.sum(self.model.explainedVariance.toArray()))

    def transform(self, vectors: DataFrame, column: str = "embedding") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        given = F.col(quote(column))
        zeros = F.array_repeat(F.lit(0.0), self.model.pc.numRows)
        filled = vectors.select("*", F.coalesce(given.cast("array<double>"), zeros).alias("_filled"))
        out = self.model.transform(_as_vectors(filled, "_filled"))
        reduced = F.when(given.isNotNull(), vector_to_array("_out", "float32")).alias(column)
        return out.select(*[reduced if c == column else F.col(quote(c)) for c in vectors.columns])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Compressor:
        from pyspark.ml.feature import PCAModel

        model = PCAModel.load(path)
        out = cls(dimensions=model.getK())
        out.model = model
        return out


def _as_vectors(df: DataFrame, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_in", array_to_vector(F.col(quote(column)).cast("array<double>")))
