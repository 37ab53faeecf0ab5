"""spark.read.format("papers"): source archives by id, from a cache folder or, if allowed, over the network."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from texmill.sources.papers import fetch


class Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class PaperReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ids = [i.strip() for i in options.get("ids", "").split(",") if i.strip()]
        self.cache, self.online = options["cache"], options.get("online", "false").lower() == "true"

    def partitions(self) -> list[Ids]:
        """One partition while the network is asked, so that requests keep their distance; else one per id."""
        return [Ids(self.ids)] if self.online else [Ids([i]) for i in self.ids]

    def read(self, partition: Ids):
        paths = fetch(partition.ids, self.cache) if self.online else [os.path.join(self.cache, i.replace("/", "_") + ".tar.gz") for i in partition.ids]
        for i, path in zip(partition.ids, paths, strict=True):
            if os.path.exists(path):
                with open(path, "rb") as f:
                    yield i, path, f.read()


class Papers(DataSource):
    """Options: ids (comma list), cache (a folder that all executors see), online (false unless asked for)."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return "paper_id string, path string, content binary"

    def reader(self, schema) -> PaperReader:
        return PaperReader(self.options)
