"""A dataset: column roles, split, fitted statistics, features, and the normalisation of training and scoring rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.columns import embedding_name, quote, safe_cast
from tabflow.functions.types import spark_type
from tabflow.operators.embed import Compressor, Embedder, EmbeddingStore, attach, distinct_texts, embed_column, embed_rows, embed_texts
from tabflow.operators.encode import encode_ordinal, one_hot, one_hot_values
from tabflow.operators.impute import impute
from tabflow.operators.query import features_and_target, segment
from tabflow.operators.stats import ALL_STATS, Categories, Statistics, fit_categories, fit_statistics
from tabflow.plans.columns import ColumnSpec, check_roles
from tabflow.plans.features import Feature, FeatureList, FeatureStore
from tabflow.session import scratch_path
from tabflow.sources.store import write_snapshot

_CHEAP = ("num_rows", "null_count", "mean", "min", "max", "std", "last_value")


class Dataset:
    def __init__(
        self,
        columns: Sequence[ColumnSpec],
        splitter: Any = None,
        features: Sequence[Feature] | FeatureList = (),
        embedders: Mapping[str, Embedder] | None = None,
        run_date: dt.date | None = None,
        root: str | None = None,
    ):
        self.columns = list(columns)
        if getattr(splitter, "date_col", None) and not any(c.is_date_column for c in self.columns):
            # The column by which rows are split is the one that orders them.
            self.columns = [replace(c, is_date_column=c.name == splitter.date_col) for c in self.columns]
        check_roles(self.columns)
        self.splitter = splitter
        self.features = features if isinstance(features, FeatureList) else FeatureList(features)
        self.embedders = dict(embedders or {})
        self.run_date = run_date
        self.root = root
        self.raw_statistics = Statistics()
        self.processed_statistics = Statistics()
        self.profile = Statistics()
        self.categories: dict[str, Categories] = {}
        self._stores: dict[str, FeatureStore] = {}

    # ------------------------------------------------------------ roles

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def _role(self, role: str) -> str | None:
        return next((c.name for c in self.columns if getattr(c, role)), None)

    @property
    def target(self) -> str | None:
        return self._role("is_target")

    @property
    def primary_key(self) -> str | None:
        return self._role("is_primary_key")

    @property
    def date_column(self) -> str | None:
        return self._role("is_date_column")

    # ------------------------------------------------------------ fit

    def split(self, df: DataFrame) -> DataFrame:
        """Adds the ``split`` column, unless the frame has one; the splitter is fitted to this frame."""
        if "split" in df.columns:
            return df
        if self.splitter is None:
            raise ValueError("the dataset has no splitter and the frame no split column")
        if hasattr(self.splitter, "fit"):
            self.splitter.fit(df)
        return self.splitter.assign(df)

    def fit(self, df: DataFrame, profile: bool = False) -> Dataset:
        """Learns everything that normalisation needs, values from training rows only.

        ``profile`` learns every statistic of every column; otherwise distinct counts, modes and medians are computed
        only for columns whose steps use them.
        """
        rows = self.split(df)
        root = self._root(df.sparkSession)
        train = F.col("split") == "train"
        given = [c for c in self.columns if not c.is_computed and c.name in rows.columns]
        rows = self._typed(rows)
        self.categories = self._learn_categories(rows, given, train, f"{root}/raw")
        self.raw_statistics = self._learn(rows, given, train, profile)
        self._stores = self.features.stores(df.sparkSession, f"{root}/features")
        self.features.fit(rows, self._stores)
        computed = [c for c in self.columns if c.is_computed]
        if computed:
            built = self._with_features(rows, inference=False)
            self.categories.update(self._learn_categories(built, computed, train, f"{root}/computed"))
            self.processed_statistics = self._learn(built, computed, train, profile)
        for c in self.columns:
            if c.encoding == "embedding" and c.name in rows.columns:
                self._fit_embedding(rows, c, train)
        return self

    def _fit_embedding(self, rows: DataFrame, spec: ColumnSpec, train: Column) -> None:
        """Stores vectors of all texts; with ``dimensions`` or ``preset``, also reduced ones, by a PCA of training texts."""
        store = self._embeddings(rows.sparkSession, spec.name)
        store.update(rows, spec.name, self.embedders[spec.name])
        wanted = {k: spec.training.param(k) for k in ("dimensions", "preset") if spec.training.param(k) is not None}
        if wanted:
            texts = distinct_texts(rows.filter(train), spec.name).select("text_key")
            pca = Compressor(**wanted).fit(store.full.read().join(texts, "text_key", "left_semi"))
            pca.save(self._pca_path(rows.sparkSession, spec.name))
            store.compress(pca)

    def _pca_path(self, spark: SparkSession, column: str) -> str:
        return f"{self._root(spark)}/embeddings/{column}/pca"

    def _root(self, spark: SparkSession) -> str:
        if self.root is None:
            self.root = scratch_path(spark, "dataset")
        return self.root

    def _learn(self, rows: DataFrame, columns: Sequence[ColumnSpec], train: Column, profile: bool) -> Statistics:
        date = self.date_column if self.date_column in rows.columns else None
        clips = {c.name: c.training.clip_bounds() for c in columns if c.training and c.training.clip_bounds() and not c.is_computed}
        common = {"train": train, "date_column": date, "tiebreak": self.primary_key if self.primary_key in rows.columns else None, "clips": clips}
        names = [c.name for c in columns]
        if not names:
            return Statistics()
        if profile:
            return fit_statistics(rows, names, stats=ALL_STATS, **common)
        out = fit_statistics(rows, names, stats=_CHEAP, **common)
        for method, stat in (("median", "median"), ("most_frequent", "most_frequent_value")):
            users = [c.name for c in columns if any(s and s.method == method for s in (c.training, c.inference))]
            if method == "most_frequent":
                # Columns whose categories were learned have their mode from the same counts.
                known = {c: {stat: self.categories[c].mode} for c in users if c in self.categories}
                out.update(Statistics(known))
                users = [c for c in users if c not in known]
            if users:
                out.update(fit_statistics(rows, users, stats=(stat,), **common))
        return out

    def _learn_categories(self, rows: DataFrame, columns: Sequence[ColumnSpec], train: Column, keep_at: str) -> dict[str, Categories]:
        wanted = {
            c.name: c.categorical_min
            for c in columns
            if c.datatype in ("categorical", "boolean") and any(s and s.uses_categories for s in (c.training, c.inference))
        }
        return fit_categories(rows, wanted, train, keep_at)

    def _statistics(self) -> Statistics:
        computed = {c.name for c in self.columns if c.is_computed}
        merged = {c: v for c, v in self.raw_statistics.columns.items() if c not in computed}
        merged.update({c: v for c, v in self.processed_statistics.columns.items() if c in computed})
        return Statistics(merged)

    # ------------------------------------------------------------ normalise

    def normalize(
        self, df: DataFrame, inference: bool = False, all_columns: bool = False, split_ys: bool = False, verify_rows: bool = False
    ) -> DataFrame | tuple[DataFrame, DataFrame]:
        """Impute, cast, add features, impute and encode, mask columns, drop incomplete training rows. One lazy plan.

        A ``split`` column is carried along. Rows to be scored are never dropped.
        """
        if inference:
            df = self.add_missing(df)
        df = self._with_features(df, inference, verify_rows)
        if inference:
            df = self.cast(df)
        df = self._impute(df, inference)
        df = self._encode(df, inference)
        if not all_columns:
            df = self.mask(df, inference)
        if not inference:
            df = self.drop_incomplete(df)
        if split_ys:
            return features_and_target(df, self.target)
        return df

    def _with_features(self, df: DataFrame, inference: bool, verify_rows: bool = False) -> DataFrame:
        df = self.cast(self._impute(df, inference))
        if self.features and not self._stores:
            self._stores = self.features.stores(df.sparkSession, f"{self._root(df.sparkSession)}/features")
        df = self.features.apply(df, self._stores, verify_rows, complete=not inference)
        # A feature may not know its value when scoring; its column is then imputed like any other.
        return self.add_missing(df, computed=True) if inference else df

    def _impute(self, df: DataFrame, inference: bool) -> DataFrame:
        steps = {c.name: c.step(inference) for c in self.columns if c.step(inference) is not None}
        return impute(df, steps, self._statistics(), self.categories, self.run_date)

    def _encode(self, df: DataFrame, inference: bool) -> DataFrame:
        """One-hot columns of all parents come from one projection; long ordinal lists and embeddings are joins."""
        out, plain = [], set(df.columns)
        for name in df.columns:
            spec = next((c for c in self.columns if c.name == name), None)
            step = spec.step(inference) if spec else None
            cats = self.categories.get(name)
            if step and step.encoding == "one_hot" and cats is not None:
                new = one_hot(F.col(quote(name)), name, one_hot_values(cats, spec.datatype == "categorical"))
                out += [c for c, v in zip(new, spec.virtual_columns(cats)) if v not in plain]
            else:
                out.append(F.col(quote(name)))
        df = df.select(out)
        for c in self.columns:
            step = c.step(inference)
            if step and step.encoding == "ordinal" and c.name in df.columns and c.name in self.categories:
                df = encode_ordinal(df, c.name, self.categories[c.name])
            if step and step.encoding == "embedding" and c.name in df.columns:
                df = self._embed(df, c.name)
        return df

    def _embeddings(self, spark: SparkSession, column: str) -> EmbeddingStore:
        return EmbeddingStore(spark, f"{self._root(spark)}/embeddings/{column}")

    def _embed(self, df: DataFrame, column: str) -> DataFrame:
        """Stored vectors by a join, new texts by the embedder."""
        spark, params = df.sparkSession, self.column(column).training
        store, embedder = self._embeddings(spark, column), self.embedders.get(column)
        reduce = params.param("dimensions") is not None or params.param("preset") is not None
        pca = Compressor.load(self._pca_path(spark, column)) if reduce else None
        if pca is not None and not df.isStreaming:
            vectors = store.compressed.read()
            if embedder is not None:
                new = distinct_texts(df, column).join(vectors.select("text_key"), "text_key", "left_anti")
                vectors = vectors.unionByName(pca.transform(embed_texts(new, embedder)))
            return attach(df, column, vectors)
        if not store.full.is_empty():
            df = store.attach(df, column)
        if embedder is not None:
            df = (embed_rows if df.isStreaming else embed_column)(df, column, embedder)
        return df if pca is None else pca.transform(df, embedding_name(column))

    def add_missing(self, df: DataFrame, computed: bool = False) -> DataFrame:
        """Absent input columns (or computed ones) as typed NULLs; a one-hot parent only if not all of its virtual
        columns are there."""
        absent = []
        for c in self.columns:
            if c.name in df.columns or c.is_computed != computed or c.is_target:
                continue
            virtual = c.virtual_columns(self.categories.get(c.name))
            if not (virtual and all(v in df.columns for v in virtual)):
                absent.append(F.lit(None).cast(spark_type(c.datatype)).alias(c.name))
        return df.select("*", *absent) if absent else df

    def _typed(self, df: DataFrame) -> DataFrame:
        return self.cast(df, given_only=True)

    def cast(self, df: DataFrame, given_only: bool = False) -> DataFrame:
        """Every known column to its declared type; a value that does not fit becomes NULL."""
        specs = {c.name: c for c in self.columns if not (given_only and c.is_computed)}
        one_hot_names = {v for c in self.columns if c.encoding == "one_hot" for v in c.virtual_columns(self.categories.get(c.name))} - set(specs)
        out = []
        for f in df.schema.fields:
            c = F.col(quote(f.name))
            if f.name in one_hot_names:
                c = safe_cast(c, f.dataType, T.BooleanType())
            spec = specs.get(f.name)
            if spec is not None and spec.datatype != "array":
                target = spark_type(spec.datatype)
                if isinstance(f.dataType, T.TimestampType) and isinstance(target, T.TimestampNTZType):
                    target = f.dataType
                c = safe_cast(c, f.dataType, target)
            out.append(c.alias(f.name))
        return df.select(out)

    def mask(self, df: DataFrame, inference: bool = False) -> DataFrame:
        """Visible columns in declared order, virtual columns in the place of their parent; no target when scoring."""
        wanted: list[str] = []
        for c in self.columns:
            if c.hidden or (inference and c.is_target):
                continue
            wanted += c.virtual_columns(self.categories.get(c.name)) or [c.name]
        wanted += [c for c in df.columns if c == "split" and c not in wanted]
        return df.select([F.col(quote(c)) for c in wanted if c in df.columns])

    def drop_incomplete(self, df: DataFrame) -> DataFrame:
        named = [c.name for c in self.columns if c.drop_if_null and c.name in df.columns]
        return df.dropna(subset=named) if named else df

    def hidden_columns(self) -> list[str]:
        return [n for c in self.columns if c.hidden for n in (c.name, *c.virtual_columns(self.categories.get(c.name)))]

    # ------------------------------------------------------------ required fields

    def check_required(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that can be scored, and rejected rows with the names of the required columns they lack."""
        checks = [
            F.when(F.col(quote(c.name)).isNull(), F.lit(c.name)) if c.name in df.columns else F.lit(c.name)
            for c in self.columns
            if c.required
        ]
        lacking = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        marked = df.withColumn("missing_fields", lacking)
        good = F.size("missing_fields") == 0
        return marked.filter(good).drop("missing_fields"), marked.filter(~good)

    # ------------------------------------------------------------ tables

    def process(self, df: DataFrame, path: str, version: str | None = None) -> DataFrame:
        """Fits on the source and writes the normalised rows of all splits as one table partitioned by split."""
        rows = self.split(df)
        self.fit(rows)
        if version is not None:
            write_snapshot(self.normalize(rows), path, version, ["split"])
            return df.sparkSession.read.parquet(f"{path}/version={version}")
        self.normalize(rows).write.mode("overwrite").partitionBy("split").parquet(path)
        return df.sparkSession.read.parquet(path)

    def learn_processed(self, processed: DataFrame) -> Statistics:
        """Statistics of the processed table, e.g. for its profile."""
        names = [c for c in processed.columns if c != "split"]
        found = fit_statistics(processed, names, train=F.col("split") == "train", stats=ALL_STATS)
        self.profile = found
        return found

    def read_segment(self, processed: DataFrame, name: str = "all", all_columns: bool = False) -> DataFrame:
        return segment(processed, name, self.hidden_columns(), all_columns)

    # ------------------------------------------------------------ state

    def save(self, spark: SparkSession, path: str) -> None:
        """Fitted state as one JSON document next to the data."""
        state = {
            "columns": [c.to_dict() for c in self.columns],
            "raw": self.raw_statistics.to_json(),
            "processed": self.processed_statistics.to_json(),
            "profile": self.profile.to_json(),
            "categories": {c: {"values": v.values, "path": v.path} for c, v in self.categories.items()},
            "root": self.root,
            "run_date": self.run_date.isoformat() if self.run_date else None,
        }
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: Sequence[Feature] = (), embedders: Mapping[str, Embedder] | None = None) -> Dataset:
        """The fitted dataset; features and embedders are code and are passed in."""
        state = json.loads(spark.read.option("wholetext", True).text(path).first().value)
        run_date = dt.date.fromisoformat(state["run_date"]) if state["run_date"] else None
        out = cls([ColumnSpec(**c) for c in state["columns"]], features=features, embedders=embedders, run_date=run_date, root=state["root"])
        out.raw_statistics = Statistics.from_json(state["raw"])
        out.processed_statistics = Statistics.from_json(state["processed"])
        out.profile = Statistics.from_json(state["profile"])
        for c, kept in state["categories"].items():
            table = spark.read.parquet(kept["path"]) if kept["path"] else None
            out.categories[c] = Categories(kept["values"], table, kept["path"])
        return out


def decode_target(df: DataFrame, dataset: Dataset, column: str) -> DataFrame:
    """Predicted codes of an ordinal target back to its values."""
    from tabflow.operators.encode import decode_column

    return decode_column(df, column, dataset.categories[dataset.target])


def embedding_columns(dataset: Dataset) -> list[str]:
    return [embedding_name(c.name) for c in dataset.columns if c.encoding == "embedding"]
