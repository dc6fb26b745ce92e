"""A data source of image files: it lists them, plans partitions by what reading them costs, and reads ranges of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .ranges import listed, packed

FORMAT = "image_files"
#: What one partition's files cost to open and read, in bytes, unless the option says otherwise.
PART_BYTES = 128 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


class ImageFiles(DataSource):
    """Fields of records of the files below a path; options: columns (of a record), suffixes, parts, partBytes.

    The fields follow from the columns asked for, and what is read of a file from the fields.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> list[str]:
        from ..operators.metadata import RECORD_COLUMNS

        return self.options["columns"].split(",") if self.options.get("columns") else list(RECORD_COLUMNS)

    def schema(self) -> str:
        from ..operators.metadata import ddl, fields_for

        return ddl(fields_for(self._columns()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._columns(), tuple(filter(None, self.options.get("suffixes", "").split(","))), int(self.options.get("partBytes", PART_BYTES)), int(self.options.get("parts", 1)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], suffixes: tuple[str, ...], part_bytes: int, parts: int):
        self.path, self.columns, self.suffixes, self.part_bytes, self.parts = path, columns, suffixes, part_bytes, parts

    def partitions(self) -> list[InputPartition]:
        return [Files(x) for x in packed(listed(self.path, self.suffixes), self.part_bytes, self.parts)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from ..operators.metadata import decoded_files

        return decoded_files(partition.value, self.columns)
