"""A Python data source over paged search listings: one input partition per calendar quarter."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .documents import quarters


class Quarter(InputPartition):
    def __init__(self, start: str, end: str):
        super().__init__((start, end))
        self.start, self.end = start, end


class FilingSearch(DataSource):
    """Options: pages (path of JSON lines files of saved result pages, named <first day>.jsonl), start, end, forms (comma-separated, optional).

    Remote fetching is left to a caller-supplied mirror: pages are read from the path, so that tests and air-gapped clusters work alike.
    """

    @classmethod
    def name(cls) -> str:
        return "filing_search"

    def schema(self) -> str:
        return "id string, cik string, name string, form string, filed string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Quarter(a, b) for a, b in quarters(self.options["start"], self.options["end"])]

    def read(self, partition: Quarter) -> Iterator[tuple]:
        forms = {f.strip() for f in self.options.get("forms", "").split(",") if f.strip()}
        try:
            lines = open(f"{self.options['pages']}/{partition.start}.jsonl", encoding="utf-8")  # noqa: SIM115
        except FileNotFoundError:
            return
        with lines:
            for line in lines:
                for hit in json.loads(line)["hits"]["hits"]:
                    s = hit["_source"]
                    if partition.start <= s["file_date"] <= partition.end and (not forms or s["form"] in forms):
                        yield hit["_id"].split(":")[0], (s["ciks"] or [None])[0], (s["display_names"] or [None])[0], s["form"], s["file_date"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilingSearch)
