"""A stream of rows upserted into a repository, a batch at a time (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..repository import Repository
from ..sources.storage import SnapshotTable


def upsert_stream(rows: DataFrame, table: SnapshotTable, checkpoint: str, ordinal: str | None = None, trigger: dict | None = None):
    """Start a query that upserts each micro-batch; the newest row of a key, by `ordinal`, wins within a batch.

    A batch that is repeated after a failure changes nothing but times, as upserting twice is upserting once.
    """

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                Repository.open(table).upsert(batch, ordinal)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changed_since(repository: Repository, timestamp: int) -> DataFrame:
    """Records written after a time: what a poller asks for."""
    from ..builder import m

    return repository.query().where(m("__timestamp") > timestamp).everything()
