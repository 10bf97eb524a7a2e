"""A Python data source that replays collected posts, one partition for each row group of the files, or for each platform if there is a limit.

Options: ``path`` (a Parquet file or folder with social and posts), ``search`` (only posts that mention it), ``no_post`` (items asked
for, with each platform's own limit). A filter on ``social`` leaves out the partitions of other platforms.
Live collection needs a network and accounts and is not part of this library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from postmill.model import COLLECTED, QUORA, SCRAPED, TWITTER

NAME = "postmill_replay"


class Platform(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class RowGroup(InputPartition):
    def __init__(self, path: str, group: int):
        super().__init__((path, group))
        self.path, self.group = path, group


class ReplayReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.platforms = list(COLLECTED)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("social",):
                self.platforms = [p for p in self.platforms if p == f.value]
            elif isinstance(f, In) and f.attribute == ("social",):
                self.platforms = [p for p in self.platforms if p in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.options.get("no_post") is not None:
            return [Platform(p) for p in self.platforms]
        import pyarrow.dataset as ds

        files = ds.dataset(self.options["path"], format="parquet").get_fragments()
        return [RowGroup(f.path, g.id) for f in files for g in f.row_groups]

    def _attempts(self, platform: str) -> int | None:
        n = self.options.get("no_post")
        if n is None:
            return None
        return 4 if platform == QUORA else max(0, (min(int(n), 25) if platform == TWITTER else int(n)) - 1)

    def read(self, partition: Platform | RowGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        term = self.options.get("search")
        if isinstance(partition, RowGroup):
            (whole,) = ds.dataset(partition.path, format="parquet").get_fragments()
            part = whole.subset(row_group_ids=[partition.group])
            for batch in part.to_batches(columns=["social", "posts"], filter=ds.field("social").isin(self.platforms) & ds.field("posts").is_valid()):
                yield batch.filter(pc.fill_null(pc.match_substring(batch["posts"], term, ignore_case=True), False)) if term else batch
            return
        left = self._attempts(partition.name)
        data = ds.dataset(self.options["path"], format="parquet")
        for batch in data.to_batches(columns=["social", "posts"], filter=ds.field("social") == partition.name):
            if term:
                batch = batch.filter(pc.fill_null(pc.match_substring(batch["posts"], term, ignore_case=True), False))
            if left is not None:
                batch, left = batch[:left], left - min(left, len(batch))
            # An item without text has used up its attempt.
            yield batch.filter(batch["posts"].is_valid())
            if left == 0:
                return


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return SCRAPED

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReplaySource)
