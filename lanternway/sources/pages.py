"""Track points in numbered pages per box, as a service for boxes of at most half a degree hands them out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = 5000
COLUMNS = "track string, place long, lon double, lat double, time string"


class Box(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)


class PagedPoints(DataSource):
    """``format("paged_points")`` with options ``path`` and ``boxes``: a partition a box.

    A box is asked for page 0, 1, 2 ... until a page is missing or empty. Pages lie in ``box=b/page=p`` below
    `path`, which may be any store that pyarrow's file systems reach; a task holds one page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_points"

    def schema(self) -> str:
        return f"box int, page int, {COLUMNS}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options["path"], int(self.options["boxes"]))


class PagedReader(DataSourceReader):
    def __init__(self, path: str, boxes: int) -> None:
        self.path, self.boxes = path, boxes

    def partitions(self) -> list[Box]:
        return [Box(k) for k in range(self.boxes)]

    def read(self, box: Box) -> Iterator[pa.RecordBatch]:
        for page in count():
            table = self._page(box.value, page)
            if table is None or not table.num_rows:
                return
            ahead = [pa.array([v] * table.num_rows, pa.int32()) for v in (box.value, page)]
            yield pa.RecordBatch.from_arrays([*ahead, *(c.combine_chunks() for c in table.columns)], ["box", "page", *table.column_names])

    def _page(self, box: int, page: int) -> pa.Table | None:
        store, folder = fs.FileSystem.from_uri(f"{self.path}/box={box}/page={page}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)))
        return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(columns=names).cast(kinds) for f in sorted(files)]) if files else None


def read_pages(spark: SparkSession, path: str, boxes: int) -> DataFrame:
    """Points of all boxes: ``box, page, track, place, lon, lat, time``."""
    spark.dataSource.register(PagedPoints)
    return spark.read.format("paged_points").option("path", path).option("boxes", str(boxes)).load()


def timed_tracks(points: DataFrame) -> DataFrame:
    """Each track of a box up to its first point without a time: ``agent_id, time, lon, lat`` and ``box, place``."""
    untimed = F.min(F.when(F.col("time").isNull(), F.col("place"))).alias("_stop")
    stop = points.groupBy("box", "track").agg(untimed).where("_stop is not null")
    kept = points.join(stop, ["box", "track"], "left").where("_stop is null or place < _stop")
    return kept.select(F.col("track").alias("agent_id"), "time", "lon", "lat", "box", "place")


def box_of(x: Column, y: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    """The number of the box that holds a point; points outside belong to the box at the edge."""
    west, south = boxes[0][0], boxes[0][1]
    dx, dy = boxes[0][2] - west, boxes[0][3] - south
    ny = sum(b[0] == west for b in boxes)
    at = lambda v, low, d, n: F.lit(0) if d <= 0 else F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / d)))
    return (at(x, west, dx, len(boxes) // ny) * ny + at(y, south, dy, ny)).cast("int")


def write_pages(points: DataFrame, path: str, page: int = PAGE) -> None:
    """``box, track, place, lon, lat, time`` as pages of `page` points a box, in the order of place."""
    number = F.row_number().over(Window.partitionBy("box").orderBy("place")) - 1
    pages = points.withColumn("page", F.floor(number / page))
    pages.select("box", "page", *[c.split()[0] for c in COLUMNS.split(", ")]).write.partitionBy("box", "page").parquet(path)
