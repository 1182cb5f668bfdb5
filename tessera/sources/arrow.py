"""Arrow and feather files by date, as a data source of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .panel import filled_in


@dataclass
class Day(InputPartition):
    path: str
    day: str


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class DatedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.template = schema, options["template"]
        self.days = [d for d in options["days"].split(",") if d]

    def partitions(self) -> list[InputPartition]:
        """One per day that has a file; days without one have no rows."""
        found = []
        for day in self.days:
            path = filled_in(self.template, day)
            system, at = _located(path)
            if system.get_file_info(at).type == fs.FileType.File:
                found.append(Day(path, day))
        return found or [Day("", "")]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        """The file's batches, by the names of the schema: absent columns are null, others are left out."""
        if not partition.path:
            return
        system, at = _located(partition.path)
        want = to_arrow_schema(self.schema)
        with system.open_input_file(at) as file, pa.ipc.open_file(file) as source:
            for k in range(source.num_record_batches):
                batch = source.get_batch(k)
                columns = []
                for field in want:
                    if field.name == "day":
                        columns.append(pa.array([partition.day] * batch.num_rows, field.type))
                    elif field.name in batch.schema.names:
                        columns.append(batch.column(field.name).cast(field.type))
                    else:
                        columns.append(pa.nulls(batch.num_rows, field.type))
                yield pa.RecordBatch.from_arrays(columns, names=want.names)


class DatedArrow(DataSource):
    """``template`` with {yyyy}, {mm} and {dd}, and ``days``, yyyymmdd with commas between; the schema may have a ``day``."""

    @classmethod
    def name(cls) -> str:
        return "dated_arrow"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DatedReader(schema, self.options)


def read_arrow(spark: SparkSession, template: str, days: list[str], schema: str) -> DataFrame:
    """Feather or Arrow files of some days, a partition per file, with ``day`` (string) as the last column."""
    spark.dataSource.register(DatedArrow)
    return spark.read.format("dated_arrow").schema(f"{schema}, day string").option("template", template).option("days", ",".join(days)).load()


def index_weights(spark: SparkSession, template: str, days: list[str], instruments: DataFrame) -> DataFrame:
    """(day, ii, weight): index members by symbol (sid, weight) of daily feather files, for known instruments (ii, sid)."""
    found = read_arrow(spark, template, days, "sid string, weight double")
    return found.where("weight is not null").join(instruments.select("ii", "sid"), "sid").select("day", "ii", "weight")
