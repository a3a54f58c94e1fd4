"""Change feeds of tables: INSERT, UPDATE and DELETE images applied a row at a time, with the row itself as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several states of a key, with a time to live.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPS = ("INSERT", "UPDATE", "DELETE")
CHANGE = "id string, event string, seq long, old string, new string"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The setting that ``row_changes`` needs when its query starts; what was set before is set again."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def valid_changes(feed: DataFrame, owner: str = "owner", owners: list | None = None) -> DataFrame:
    """Changes (op, id, seq, change_id, image) that a listener takes (S16, T01): one of the three operations, with an id and a place in
    the order, and an image unless the row goes; of the listed owners, where there is a list."""
    image = (F.col("op") == "DELETE") | F.col("image").isNotNull()
    sound: Column = F.col("op").isin(*OPS) & F.col("id").isNotNull() & F.col("seq").isNotNull() & image
    return feed.where(sound if owners is None else sound & F.col(owner).isin(owners))


def once_within(feed: DataFrame, at: str, late: str, key: list[str] | None = None) -> DataFrame:
    """The first of the rows that repeat a key, as long as the watermark keeps it (T01): a feed that delivers at least once gives each once."""
    return feed.withWatermark(at, late).dropDuplicatesWithinWatermark(key or ["change_id"])


class _Rows(StatefulProcessor):
    """Of each id: the last image and its place in the order, and for a time which changes were seen.

    Each call of the state is a way to the JVM and back, so a batch reads what was seen at most once, and adds to it at once.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", "seq long, image string")
        self.seen = handle.getListState("seen", "changes array<string>", self.ttl_ms)  # one of each batch

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        known = self.image.exists()
        seq, image = tuple(self.image.get()) if known else (None, None)
        seen = {c for r in self.seen.get() for c in r[0]} if known else set()  # an id without an image has no changes yet
        first, fresh = seq, {}
        for row in sorted(rows, key=lambda r: (r.seq, r.change_id or "")):
            if row.change_id is not None:
                if row.change_id in seen or row.change_id in fresh:
                    continue
                fresh[row.change_id] = None
            if seq is not None and row.seq <= seq:
                continue  # older than what is known
            new = None if row.op == "DELETE" else row.image
            if new is not None or image is not None:
                event = "DELETE" if new is None else "UPDATE" if image is not None else "INSERT"
                yield Row(id=str(key[0]), event=event, seq=row.seq, old=image, new=new)
            seq, image = row.seq, new
        if fresh:
            self.seen.appendValue((list(fresh),))
        if seq != first:
            self.image.update((seq, image))  # a removed row keeps its place in the order, so that older changes don't bring it back

    def close(self) -> None:
        pass


def row_changes(changes: DataFrame, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """(id, event, seq, old, new): what really happens to each row, with its image before and after.

    ``changes`` has id, op, seq, change_id and image (JSON); within a batch a row's changes go by seq. A change that was seen (by
    change_id, for ``ttl_ms``), or is not newer than what is known, does nothing; without a change_id only its seq tells. An INSERT of a row that is there is
    an UPDATE, an UPDATE of one that is not there an INSERT, a DELETE of one that is not there nothing. The state is a value (the last image and
    its seq) and a list (changes seen, which expire), so it grows with the rows and not with their changes. A batch reads the list of each id
    that it has changes of. Start the query in ``keyed_state``.
    A query that is to end once its input is read (availableNow) needs ``ttl_ms`` None, as Spark goes on with batches while state can expire.
    """
    narrow = changes.select(F.col("id").cast("string").alias("id"), "op", "seq", F.col("change_id").cast("string").alias("change_id"), "image")
    return narrow.groupBy("id").transformWithState(_Rows(ttl_ms), CHANGE, "Append", "None" if ttl_ms is None else "ProcessingTime")


def current_rows(applied: DataFrame) -> DataFrame:
    """(id, seq, image) of the rows that are there after all applied changes."""
    last = applied.groupBy("id").agg(F.max_by(F.struct("seq", F.col("new").alias("image")), "seq").alias("r"))
    return last.select("id", "r.*").where("image IS NOT NULL")
