"""User operators by name: transformers with a declared warm-up, and how warm-ups add up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Transformer = Callable[..., DataFrame]


@dataclass(frozen=True)
class Operator:
    """A DataFrame transformer and the rows it needs before its first value."""

    name: str
    apply: Transformer
    min_period: int = 1
    kind: str = "indicator"


_operators: dict[str, Operator] = {}
KINDS = ("indicator", "filter", "analyzer", "sizer")


def register(name: str, apply: Transformer, min_period: int = 1, kind: str = "indicator") -> Operator:
    """Adds an indicator, filter, analyzer or sizer; a name can be taken once."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if name in _operators:
        raise ValueError(f"{name} is registered")
    _operators[name] = Operator(name, apply, min_period, kind)
    return _operators[name]


def get(name: str) -> Operator:
    return _operators[name]


def added(period: int, window: int) -> int:
    """The warm-up of a window of ``window`` rows over something that needs ``period``."""
    return period + window - 1


def joint(periods: Iterable[int]) -> int:
    """The warm-up of something that needs all of its inputs."""
    return max(periods, default=1)


def run(df: DataFrame, names: Iterable[str], **options: object) -> DataFrame:
    """Registered operators one after another."""
    for name in names:
        df = _operators[name].apply(df, **options)
    return df


def parse_times(column: Column, parser: Callable) -> Column:
    """Texts to timestamps with a Python parser of one text, in Arrow batches; what it rejects is null."""
    import pandas as pd

    def parse(texts: pd.Series) -> pd.Series:
        def one(text: str | None):  # noqa: ANN202
            try:
                return None if text is None else parser(text)
            except ValueError:
                return None

        return pd.to_datetime(texts.map(one))

    parse.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(parse, "timestamp")(column)


def feed_source(name: str, schema: StructType, parts: int, load: Callable[[int], Iterator[tuple]]) -> type[DataSource]:
    """A custom feed for ``spark.dataSource.register``: ``load(i)`` yields the rows of part i, on executors."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(parts)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from load(partition.value)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:  # noqa: ARG002
            return Reader()

    return Feed
