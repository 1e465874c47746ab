"""Logical tables by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.schemas import SCHEMAS


class Catalog(Mapping[str, DataFrame]):
    """Maps a logical table name to a DataFrame, resolved on first use.

    ``renames`` maps a logical name to ``{column in storage: column the jobs use}``,
    so warehouses with other column names can be read without a copy.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
        renames: Mapping[str, Mapping[str, str]] | None = None,
    ) -> None:
        self._tables = dict(tables)
        self._renames = dict(renames or {})
        self._resolved: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        root: str,
        names: list[str] | None = None,
        renames: Mapping[str, Mapping[str, str]] | None = None,
    ) -> Catalog:
        """One parquet data set per logical name under ``root``.

        Tables read with the declared schema, unless their columns are renamed.
        """
        renames = renames or {}

        def reader(name: str) -> Callable[[], DataFrame]:
            def read() -> DataFrame:
                source = spark.read
                if name in SCHEMAS and name not in renames:
                    source = source.schema(SCHEMAS[name])
                return source.parquet(f"{root.rstrip('/')}/{name}")

            return read

        return cls({n: reader(n) for n in names or SCHEMAS}, renames)

    @classmethod
    def from_tables(
        cls,
        spark: SparkSession,
        names: Mapping[str, str],
        renames: Mapping[str, Mapping[str, str]] | None = None,
    ) -> Catalog:
        """Metastore tables: ``{logical name: schema.table}``."""
        return cls({n: (lambda t=t: spark.table(t)) for n, t in names.items()}, renames)

    def add(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> None:
        """Add or replace a table, for example the stored result of another report."""
        self._tables[name] = table
        self._resolved.pop(name, None)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._resolved:
            table = self._tables[name]
            frame = table if isinstance(table, DataFrame) else table()
            mapping = self._renames.get(name)
            self._resolved[name] = frame.withColumnsRenamed(dict(mapping)) if mapping else frame
        return self._resolved[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def create_views(self, prefix: str = "") -> None:
        """Expose every table as a temporary view for ad-hoc SQL."""
        for name in self:
            self[name].createOrReplaceTempView(f"{prefix}{name}")
