"""User features: what to compute once and store (``fit``), and how to add columns to a frame (``transform``)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.columns import quote
from tabflow.operators.grouped import HOT_ROWS, GroupFunction, apply_by_group
from tabflow.operators.inspect import is_unique
from tabflow.operators.lookup import lookup
from tabflow.operators.query import sort_order
from tabflow.session import cut_lineage
from tabflow.sources.store import Store, WriteResult


class FeatureError(ValueError):
    pass


class Feature:
    """Subclass and set the class attributes; override ``fit`` and/or ``transform``.

    ``fit`` sees the whole frame and is one distributed job: groups are kept whole by windows and aggregations keyed on
    them, not by feeding batches. ``batch_key`` names the key by which the stored rows are partitioned, by default the
    primary key. Override ``batch`` to compute it, and set ``group_function`` instead of ``fit`` for a function of the
    whole rows of one batch key, in the order of ``group_order``.
    """

    name: str = ""
    description: str = ""
    primary_key: str | None = None
    batch_size: int = 10_000
    batch_key: str | None = None
    needs_columns: Sequence[str] = ()
    computes_columns: Sequence[str] = ()
    refresh_every: float | None = None
    group_function: GroupFunction | None = None
    group_order: Sequence[str] = ()
    group_hot_rows: int = HOT_ROWS

    def batch(self, df: DataFrame) -> Column | None:
        """The values of ``batch_key``, where they are computed from the frame."""
        return None

    def fit(self, df: DataFrame) -> DataFrame | None:
        """Rows to store, or None for a feature that only transforms."""
        return None

    def transform(self, df: DataFrame, stored: FeatureStore) -> DataFrame:
        return df

    @property
    def has_fit(self) -> bool:
        return type(self).fit is not Feature.fit or self.group_function is not None

    def with_batch_key(self, df: DataFrame) -> DataFrame:
        values = self.batch(df)
        if values is None:
            return df
        if not self.batch_key:
            raise FeatureError(f"feature {self.name}: a computed batch key needs a name in batch_key")
        return df.withColumn(self.batch_key, values)


class FeatureStore:
    """The stored rows of one feature, partitioned by ranges of its key."""

    def __init__(self, spark: SparkSession, root: str, feature: Feature):
        self.feature = feature
        key = feature.batch_key or feature.primary_key
        self.store = Store(spark, f"{root}/{feature.name}", key, feature.batch_size if key else None)

    def is_empty(self) -> bool:
        return self.store.is_empty()

    def read(self) -> DataFrame:
        return self.store.read().drop("partition")

    def query(self, **verbs) -> DataFrame:
        return self.store.query(**verbs)

    def lookup(self, keys: DataFrame, on: str | None = None) -> DataFrame:
        on = on or self.feature.primary_key
        return self.read().join(keys.select(quote(on)), on, "left_semi")

    def attach(self, df: DataFrame, on: str | None = None) -> DataFrame:
        """The frame with the stored columns of its keys, NULL where there are none. Rows without a key spread over tasks."""
        on = on or self.feature.primary_key
        return lookup(df, F.col(quote(on)), self.read().withColumnRenamed(on, "_stored_key"), "_stored_key").drop("_stored_key")

    def write(self, rows: DataFrame) -> WriteResult:
        """Adds the rows. A repeated primary key would multiply rows in the join of ``transform``, so it is refused
        before anything is written; stored keys are only compared with the new ones, not shuffled again."""
        key = self.feature.primary_key
        if key and key in rows.columns:
            rows = cut_lineage(rows)
            if not is_unique(rows.select(quote(key)), [key]):
                raise FeatureError(f"feature {self.feature.name}: fit gave the key {key} more than once")
            if not self.is_empty() and not rows.select(quote(key)).join(self.read().select(quote(key)), key, "left_semi").isEmpty():
                raise FeatureError(f"feature {self.feature.name}: some keys are stored already")
        return self.store.append(rows)


def build_batch(df: DataFrame, feature: Feature, start, end) -> DataFrame:
    """Rows of a key range with the columns the feature needs, sorted by the key."""
    key = feature.batch_key or feature.primary_key
    rows = feature.with_batch_key(df).filter(F.col(quote(key)).between(start, end))
    if feature.needs_columns:
        rows = rows.select(*[F.col(quote(c)) for c in dict.fromkeys([key, *feature.needs_columns])])
    return rows.orderBy(*sort_order([key]))


def fit_feature(df: DataFrame, feature: Feature, store: FeatureStore) -> WriteResult | None:
    if not feature.has_fit:
        return None
    source = feature.with_batch_key(df)
    if feature.needs_columns:
        keys = [k for k in (feature.primary_key, feature.batch_key) if k]
        source = source.select(*[F.col(quote(c)) for c in dict.fromkeys([*keys, *feature.group_order, *feature.needs_columns])])
    if feature.group_function is None:
        rows = feature.fit(source)
    else:
        key = feature.batch_key or feature.primary_key
        if not key:
            raise FeatureError(f"feature {feature.name}: a function by group needs a batch key")
        rows = apply_by_group(source, key, feature.group_order, feature.group_function, feature.group_hot_rows)
    if rows is None:
        return None
    if not isinstance(rows, DataFrame):
        raise FeatureError(f"feature {feature.name}: fit must return a DataFrame")
    return store.write(rows)


def apply_feature(df: DataFrame, feature: Feature, store: FeatureStore | None, verify_rows: bool = False, complete: bool = True) -> DataFrame:
    """Columns are checked on the plan. Counting rows runs both plans, so it is done on request only; the usual cause of
    extra rows, a repeated key in the store, is checked once when the feature is stored."""
    out = feature.transform(df, store)
    if not isinstance(out, DataFrame):
        raise FeatureError(f"feature {feature.name}: transform must return a DataFrame")
    lost = [c for c in df.columns if c not in out.columns]
    if lost:
        raise FeatureError(f"feature {feature.name}: transform removed {lost}")
    absent = [c for c in feature.computes_columns if c not in out.columns]
    if absent and complete:
        raise FeatureError(f"feature {feature.name}: transform did not add {absent}")
    if verify_rows:
        before, after = df.count(), out.count()
        if before != after:
            raise FeatureError(f"feature {feature.name}: {before} rows became {after}")
    return out


class FeatureList:
    """Features in the order they are applied. All fits finish before the first transform."""

    def __init__(self, features: Iterable[Feature] = ()):
        self.features = list(features)
        names = [f.name for f in self.features]
        if not all(names) or len(set(names)) != len(names):
            raise FeatureError("every feature needs a name of its own")

    def __iter__(self):
        return iter(self.features)

    def __len__(self) -> int:
        return len(self.features)

    def _at(self, name: str) -> int:
        for i, f in enumerate(self.features):
            if f.name == name:
                return i
        raise FeatureError(f"no feature {name!r}")

    def insert(self, feature: Feature) -> FeatureList:
        return FeatureList([*self.features, feature])

    def prepend(self, feature: Feature) -> FeatureList:
        return FeatureList([feature, *self.features])

    def insert_before(self, name: str, feature: Feature) -> FeatureList:
        i = self._at(name)
        return FeatureList([*self.features[:i], feature, *self.features[i:]])

    def insert_after(self, name: str, feature: Feature) -> FeatureList:
        i = self._at(name) + 1
        return FeatureList([*self.features[:i], feature, *self.features[i:]])

    def stores(self, spark: SparkSession, root: str) -> dict[str, FeatureStore]:
        return {f.name: FeatureStore(spark, root, f) for f in self.features}

    def fit(self, df: DataFrame, stores: dict[str, FeatureStore]) -> dict[str, WriteResult | None]:
        return {f.name: fit_feature(df, f, stores[f.name]) for f in self.features}

    def apply(self, df: DataFrame, stores: dict[str, FeatureStore], verify_rows: bool = False, complete: bool = True) -> DataFrame:
        """``complete`` asks every feature to add the columns it computes; scoring does not."""
        for f in self.features:
            df = apply_feature(df, f, stores.get(f.name), verify_rows, complete)
        return df
