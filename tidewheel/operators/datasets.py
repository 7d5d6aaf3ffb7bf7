"""Datasets: append-only rows with an order, read first in first out or last in first out, and a catalogue of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.operators.frontier import ordered_by
from tidewheel.sources.shared import Log

Map = Callable[[DataFrame], DataFrame]


@dataclass
class Dataset:
    """Rows of one type with ``seq``. Reading consumes: it moves an offset, the rows stay where they are.

    ``stack``: last in, first out. ``to_store`` / ``from_store`` map rows on their way in and out; ``map_error`` maps
    what goes wrong on the way.
    """

    rows: DataFrame
    stack: bool = False
    to_store: Map | None = None
    from_store: Map | None = None
    map_error: Callable[[Exception], Exception] | None = None
    unbounded: bool = False
    #: Ranges of ``seq`` that were read, disjoint and in order: one of a queue; of a stack one more for each time that rows
    #: were written between reads, until the rows below are read as well.
    _read: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def queue(cls, spark: SparkSession, schema: StructType | str) -> Dataset:
        return cls(_with_seq(spark.createDataFrame([], schema)))

    new = queue

    @classmethod
    def stacked(cls, spark: SparkSession, schema: StructType | str) -> Dataset:
        return cls(_with_seq(spark.createDataFrame([], schema)), stack=True)

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable, schema: StructType | str) -> Dataset:
        """A queue of the given rows, in their order."""
        rows = list(rows)
        ds = cls.queue(spark, schema)
        return ds.write_batch(spark.createDataFrame(rows, schema)) if rows else ds

    def reserved(self, additional: int) -> Dataset:
        """A hint that is accepted and not needed."""
        if additional < 0:
            raise ValueError("additional must not be negative")
        return self

    def map_data(self, to: Map, from_: Map) -> Dataset:
        return replace(self, to_store=to if self.to_store is None else lambda d, a=to, b=self.to_store: b(a(d)), from_store=from_ if self.from_store is None else lambda d, a=from_, b=self.from_store: a(b(d)))

    def map_err(self, f: Callable[[Exception], Exception]) -> Dataset:
        return replace(self, map_error=f)

    def boxed(self) -> Dataset:
        return self

    boxed_clone = as_dataset = boxed

    def into_split(self, checkpoint: str | None = None) -> tuple[DataSink, DataStream]:
        """A handle to write with and one to read a stream with, over one growing table in the shared folder. It begins with
        the rows that were not read yet; they count as read here."""
        log = Log(self.rows.sparkSession, [])
        sink = DataSink(self, log, (self.rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]))
        log.append(self.left().select(*self.rows.columns))
        self._take_all()
        return sink, DataStream(self, log, checkpoint)

    def into_sink(self) -> DataSink:
        return self.into_split()[0]

    def into_stream(self, checkpoint: str | None = None) -> DataStream:
        return self.into_split(checkpoint)[1]

    def write_batch(self, df: DataFrame) -> Dataset:
        """Appends rows, all or none. Their ``seq``, if any, is their order; they come after what is there."""
        try:
            df = self.to_store(df) if self.to_store else df
            last = self.rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            if "seq" in df.columns:
                df = ordered_by(df.withColumnRenamed("seq", "_o"), F.col("_o"), start=last).drop("_o")
            else:
                df = ordered_by(df.withColumn("_o", F.monotonically_increasing_id()), F.col("_o"), start=last).drop("_o")
            self.rows = self.rows.unionByName(df.select(*self.rows.columns))
        except Exception as e:
            raise (self.map_error(e) if self.map_error else e) from e
        return self

    def write(self, spark: SparkSession, row) -> Dataset:
        types = StructType([f for f in self.rows.schema.fields if f.name != "seq"])
        return self.write_batch(spark.createDataFrame([row], types))

    push = write

    def _out(self, df: DataFrame) -> DataFrame:
        return self.from_store(df) if self.from_store else df

    def left(self) -> DataFrame:
        """Rows not read yet, in reading order."""
        unread = F.lit(True)
        for low, high in self._read:
            unread = unread & ~F.col("seq").between(low, high)
        return self.rows.where(unread).orderBy(F.desc("seq") if self.stack else F.asc("seq"))

    def read_batch(self, count: int) -> DataFrame:
        """The next ``count`` rows: a top-k, not a sort of all. Only the bounds of their ``seq`` come to the driver."""
        low, high = self.left().limit(count).agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            return self._out(self.rows.limit(0))
        got = self.left().where(F.col("seq").between(low, high))
        self._note(low, high)
        return self._out(got)

    def _note(self, low: int, high: int) -> None:
        """Marks a range as read. Reading takes from one end, so ranges that it reaches or passes become one with it."""
        if not self.stack:
            low = min([low, *(a for a, _ in self._read)])
        below = [(a, b) for a, b in self._read if b < low - 1]
        joined = [(a, b) for a, b in self._read if b >= low - 1]
        self._read = [*below, (min([low, *(a for a, _ in joined)]), max([high, *(b for _, b in joined)]))]

    def _take_all(self) -> None:
        low, high = self.rows.agg(F.min("seq"), F.max("seq")).first()
        self._read = [] if low is None else [(low, high)]

    def read(self):
        """The next row, or None."""
        return self.read_batch(1).first()

    def read_all(self) -> DataFrame:
        df = self.left()
        self._take_all()
        return self._out(df)

    def len(self) -> int:
        """Rows left; 0 for an external stream, whose size nobody knows."""
        return 0 if self.unbounded else self.left().count()

    def is_empty(self) -> bool:
        return self.unbounded or self.left().isEmpty()


class DataSink:
    """The writing end of a dataset that was split: each push appends rows to the table that the stream reads."""

    def __init__(self, dataset: Dataset, log: Log, last: int):
        self.dataset, self.log, self.last = dataset, log, last

    def push(self, df: DataFrame) -> DataSink:
        own = self.dataset
        df = own.to_store(df) if own.to_store else df
        order = F.col("_o")
        df = df.withColumnRenamed("seq", "_o") if "seq" in df.columns else df.withColumn("_o", F.monotonically_increasing_id())
        df = ordered_by(df, order, start=self.last).drop("_o").select(*own.rows.columns)
        self.log.append(df)
        self.last = self.log.rows().agg(F.max("seq")).first()[0] or self.last
        return self

    write_batch = push


class DataStream:
    """The reading end of a dataset that was split: a stream of its table. ``drain`` ends where there is nothing left."""

    def __init__(self, dataset: Dataset, log: Log, checkpoint: str | None = None):
        self.dataset, self.log, self.checkpoint = dataset, log, checkpoint or f"{log.path}-checkpoint"

    def frame(self) -> DataFrame:
        rows = self.log.spark.readStream.schema(self.log.schema).parquet(self.log.path)
        return self.dataset.from_store(rows) if self.dataset.from_store else rows

    def drain(self, each: Callable[[DataFrame, int], None]) -> None:
        """Gives what was not read yet to ``each``, batch by batch; called again, it goes on where it ended."""
        self.frame().writeStream.foreachBatch(each).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()


def _with_seq(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else df.withColumn("seq", F.lit(0).cast("bigint"))


class Catalog:
    """Datasets by the name of their type; one each."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._by: dict[str, Dataset] = {}

    def set(self, name: str, dataset: Dataset) -> Catalog:
        """Registers a dataset; an earlier one of that name is replaced, its rows are not taken over."""
        self._by[name] = dataset
        return self

    def get(self, name: str, schema: StructType | str) -> Dataset:
        """The dataset of that name, or a new empty queue."""
        return self._by.setdefault(name, Dataset.queue(self.spark, schema))

    def try_get(self, name: str) -> Dataset | None:
        return self._by.get(name)

    def names(self) -> list[str]:
        return sorted(self._by)

    def __len__(self) -> int:
        return len(self._by)

    def is_empty(self) -> bool:
        return not self._by
