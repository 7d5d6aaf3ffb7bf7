"""The frontier: requests in a queue, with their tags and depths, as DataFrame transforms.

A frontier row is a request (see ``schemas.REQUEST_DDL``). ``seq`` is its place in the queue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.text import WHITE
from tidewheel.sources.shared import cut
from tidewheel.schemas import REQUEST_DDL, TAG, as_tag, depth_or_first, is_fallback, next_depth, schema, tag_or_fallback

#: A join with a level of more requests than this is a sort-merge join, see :func:`for_join`.
MERGE_ROWS = 100_000

#: A URI has no white space or controls and is absolute, or a path.
_URI = rf"^[^{WHITE}\x00-\x1f<>\"\\^`{{|}}]+\z"


def valid_uri(uri: Column) -> Column:
    """Whether ``uri`` can be requested: no white space, and a scheme's ``://`` is followed by a host."""
    return F.coalesce(uri.rlike(_URI) & ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[/?#]|\z)"), F.lit(False))


def from_urls(df: DataFrame, url: str = "uri", seq: str | None = None) -> DataFrame:
    """Requests ``GET url`` with an empty body; rows whose url is null or invalid are rejected (see :func:`rejected`)."""
    ok = df.where(valid_uri(F.col(url)))
    return as_requests(ok.withColumn("uri", F.col(url)).withColumn("method", F.lit("GET")).withColumn("body", F.lit(b"")), seq)


def rejected(df: DataFrame, url: str = "uri") -> DataFrame:
    """The rows that :func:`from_urls` leaves out, with the error."""
    from tidewheel.functions.errors import http_error

    return df.where(~valid_uri(F.col(url))).withColumn("error", http_error())


def as_requests(df: DataFrame, seq: str | None = None) -> DataFrame:
    """``df`` with all request columns; what it lacks is null, and ``GET`` / ``HTTP/1.1`` for method and version."""
    names = set(df.columns)
    given = {
        "seq": F.col(seq or "seq") if (seq or "seq") in names else F.lit(None),
        "method": F.coalesce(F.col("method"), F.lit("GET")) if "method" in names else F.lit("GET"),
        "version": F.coalesce(F.col("version"), F.lit("HTTP/1.1")) if "version" in names else F.lit("HTTP/1.1"),
    }
    return df.select(*[given.get(f.name, F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(REQUEST_DDL)])


@dataclass(frozen=True)
class Queue:
    """Defaults of a handle to the queue: its parent's depth and what rows without tag or depth get.

    ``Queue()`` is the external handle: depth 1, no defaults. ``in_handler`` is the one a handler gets.
    """

    default_tag: Column | None = None
    default_depth: Column | None = None
    depth: Column | None = None

    def with_default_tag(self, tag) -> Queue:
        return Queue(as_tag(tag), self.default_depth, self.depth)

    def with_default_depth(self, depth) -> Queue:
        return Queue(self.default_tag, depth if isinstance(depth, Column) else F.lit(depth), self.depth)

    def _depth(self) -> Column:
        return depth_or_first(self.depth if self.depth is not None else F.lit(1))

    def _default_tag(self) -> Column:
        return F.coalesce(F.col("tag"), (self.default_tag if self.default_tag is not None else F.lit(None)).cast(TAG))

    def _default_depth(self) -> Column:
        return F.coalesce(F.col("depth"), (self.default_depth if self.default_depth is not None else F.lit(None)).cast("bigint"))

    def append(self, requests: DataFrame) -> DataFrame:
        """Default tag and depth where there are none."""
        return requests.withColumns({"tag": self._default_tag(), "depth": self._default_depth()})

    def branch(self, requests: DataFrame) -> DataFrame:
        """The parent's depth and one where there is none; default tag."""
        return requests.withColumns({"tag": self._default_tag(), "depth": F.coalesce(F.col("depth"), next_depth(self._depth()))})

    def append_with_tag(self, tag, requests: DataFrame) -> DataFrame:
        """This tag whatever it was; default depth where there is none."""
        return requests.withColumns({"tag": as_tag(tag).cast(TAG), "depth": self._default_depth()})

    def branch_with_tag(self, tag, requests: DataFrame) -> DataFrame:
        """This tag and the parent's depth and one, whatever they were."""
        return requests.withColumns({"tag": as_tag(tag).cast(TAG), "depth": next_depth(self._depth())})


def in_handler(parent_tag: str = "parent_tag", parent_depth: str = "parent_depth") -> Queue:
    """The handle of a handler's children, which carry their parent's tag and depth in these columns."""
    tag = F.when(~is_fallback(F.col(parent_tag)), F.col(parent_tag).cast(TAG))
    depth = depth_or_first(F.col(parent_depth))
    return Queue(tag, depth, depth)


def settle(requests: DataFrame) -> DataFrame:
    """What reading a request gives: the fallback tag and depth 1 where nothing is set."""
    return requests.withColumns({"tag": tag_or_fallback(F.col("tag")), "depth": depth_or_first(F.col("depth"))})


def for_join(level: DataFrame, rows: int | None) -> DataFrame:
    """``level``, or columns of it, as a side of a join: not broadcast if it has over ``MERGE_ROWS`` rows, or nobody knows how many.

    A level's files are compressed and a few of its columns are a small share of them, so Spark takes it for far smaller
    than it is, and a broadcast goes through the driver's memory.
    """
    return level.hint("merge") if rows is None or rows > MERGE_ROWS else level


def ordered_by(df: DataFrame, *order: Column, start: int = 0, name: str = "seq", folders: list[str] | None = None) -> DataFrame:
    """``df`` with a dense place in ``order``, from ``start`` + 1, without gathering the rows in one task.

    Rows are sorted by range; each partition's rows are counted, the counts (one per partition) come to the driver, and
    each row gets its partition's offset plus its place in it. Ties keep an arbitrary order, so give a total one.
    The sorted rows are written to the shared folder, which is added to ``folders``: the counts hold only for the partitions
    that they were taken from, and a second sort may draw other bounds or have its partitions coalesced otherwise.
    """
    spark = df.sparkSession
    part = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), folders)
    counts = {r["_part"]: r["count"] for r in part.groupBy("_part").count().collect()}
    offsets, total = [], start
    for p in sorted(counts):
        offsets.append((p, total - p * (1 << 33)))
        total += counts[p]
    base = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_part int, _base bigint"))
    return part.join(base, "_part").withColumn(name, F.col("_id") + F.col("_base") + 1).drop("_part", "_id", "_base")


def seed(initial: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Initial requests, written in reverse after what is queued: the last one given comes first (``seq`` is the order given)."""
    count = 0
    if queued is not None:
        count = queued.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    reversed_ = ordered_by(initial.withColumnRenamed("seq", "_given"), F.desc("_given"), start=count).drop("_given")
    return reversed_ if queued is None else queued.unionByName(reversed_)


def fifo(requests: DataFrame) -> DataFrame:
    """First in, first out: breadth first."""
    return requests.orderBy("seq")


def lifo(requests: DataFrame) -> DataFrame:
    """Last in, first out: depth first."""
    return requests.orderBy(F.desc("seq"))


def within(requests: DataFrame, max_depth: int) -> DataFrame:
    return requests.where(depth_or_first(F.col("depth")) <= max_depth)


def unseen(requests: DataFrame, visited: DataFrame, by: str = "uri") -> DataFrame:
    """Requests for what was not visited, one for each ``by`` (the first in the queue)."""
    first = requests.groupBy(by).agg(F.min("seq").alias("seq"))
    once = requests.join(first, [by, "seq"], "left_semi")
    return once.join(visited.select(by), by, "left_anti")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema(REQUEST_DDL))

