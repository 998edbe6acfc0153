"""Connectors as Spark data sources, and stand-ins for external models.

A connector lists documents and fetches them; registered once, it is read by spark.read.format(name) with
one task for each slice of the listing. Network services plug in by a subclass; the one here reads memory.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Connector:
    """discover() gives document ids, fetch(id) gives (title, text)."""

    def discover(self) -> list[str]:
        raise NotImplementedError

    def fetch(self, document_id: str) -> tuple[str, str]:
        raise NotImplementedError


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, slices: int):
        self.connector, self.slices = connector, slices

    def partitions(self):
        ids = self.connector.discover()
        n = max(1, min(self.slices, len(ids)))
        return [InputPartition(ids[i::n]) for i in range(n)]

    def read(self, partition):
        for document_id in partition.value:
            yield (document_id, *self.connector.fetch(document_id))


def data_source(name: str, connector: Connector) -> type[DataSource]:
    """A data source class; pass it to spark.dataSource.register."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "document_id string, title string, content string"

        def reader(self, schema):
            return _Reader(connector, int(self.options.get("slices", "8")))

    return Source


class Memory(Connector):
    def __init__(self, documents: dict[str, tuple[str, str]]):
        self.documents = documents

    def discover(self) -> list[str]:
        return sorted(self.documents)

    def fetch(self, document_id: str) -> tuple[str, str]:
        return self.documents[document_id]


def hashing_vector(words: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a text embedding: signed counts of hashed words, scaled to length 1, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def vector(batch):
        def one(found):
            h = np.fromiter((zlib.crc32(w.encode()) for w in ([] if found is None else found)), np.int64)
            v = np.bincount(h % dim, np.where(h >> 31 & 1, -1.0, 1.0), dim)
            size = np.linalg.norm(v)
            return v / size if size else v

        return batch.map(one)

    return vector(words)
