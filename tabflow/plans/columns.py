"""Column metadata of a dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from tabflow.functions.columns import embedding_name, virtual_name
from tabflow.functions.types import ENCODINGS, IMPUTE_METHODS, SPARK_TYPES
from tabflow.operators.encode import one_hot_values
from tabflow.operators.impute import Step
from tabflow.operators.stats import Categories


@dataclass
class ColumnSpec:
    name: str
    datatype: str
    is_target: bool = False
    hidden: bool = False
    drop_if_null: bool = False
    is_date_column: bool = False
    is_primary_key: bool = False
    is_computed: bool = False
    computed_by: str | None = None
    training: Step | None = None
    inference: Step | None = None
    sample_values: list[Any] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.datatype not in SPARK_TYPES:
            raise ValueError(f"column {self.name}: unknown datatype {self.datatype!r}")
        self.training, self.inference = Step.of(self.training), Step.of(self.inference)
        if self.computed_by is not None:
            self.is_computed = True
        for step in (self.training, self.inference):
            if step is None:
                continue
            if step.method is not None and step.method not in IMPUTE_METHODS.get(self.datatype, ()):
                raise ValueError(f"column {self.name}: {step.method!r} does not apply to {self.datatype}")
            if step.encoding is not None and step.encoding not in ENCODINGS.get(self.datatype, ()):
                raise ValueError(f"column {self.name}: {step.encoding!r} does not apply to {self.datatype}")

    def step(self, inference: bool) -> Step | None:
        """Inference falls back to the training step."""
        return self.inference if inference and self.inference is not None else self.training

    @property
    def encoding(self) -> str | None:
        return self.training.encoding if self.training else None

    @property
    def categorical_min(self) -> int:
        if self.datatype != "categorical" or self.training is None:
            return 1
        return self.training.param("categorical_min") or 1

    @property
    def required(self) -> bool:
        """An input without which a row cannot be scored."""
        return not (self.is_computed or self.training or self.hidden or self.is_target)

    def virtual_columns(self, categories: Categories | None) -> list[str]:
        if self.encoding == "one_hot" and categories is not None:
            return [virtual_name(self.name, v) for v in one_hot_values(categories, self.datatype == "categorical")]
        if self.encoding == "embedding":
            return [embedding_name(self.name)]
        return []

    def to_dict(self) -> dict[str, Any]:
        d = asdict(self)
        d.pop("sample_values")
        return d


def check_roles(columns: Sequence[ColumnSpec]) -> None:
    """At most one target, one primary key and one date column; unique names."""
    names = [c.name for c in columns]
    if len(set(names)) != len(names):
        raise ValueError("column names must be unique")
    for role in ("is_target", "is_primary_key", "is_date_column"):
        holders = [c.name for c in columns if getattr(c, role)]
        if len(holders) > 1:
            raise ValueError(f"only one column may have {role}: {holders}")
