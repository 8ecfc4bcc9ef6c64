"""The dispatch log as a stored table: snapshot, deltas, archive.

Rows are only ever appended, each append a delta of its own. The state of a
turbine is its newest row or, at equal times, rows (``dispatch.latest_log_rows``).
Compaction writes a snapshot of the state and moves the deltas to the archive;
from then on the state is that of the snapshot and the deltas behind it, and
a reader of the state never opens the archive. Appends and compactions are commits
(``sources.versions``): readers see whole ones, and writers may run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustline.operators import dispatch as D
from gustline.schemas import MONITORING_COLUMNS, MONITORING_SCHEMA
from gustline.sources import files
from gustline.sources.versions import Conflict, Versions

ARCHIVE_FILE_BYTES = 16 * 1024 * 1024
EMPTY = {"snapshot": None, "deltas": [], "archive": []}


class TicketLog:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.versions, self.keep = spark, Versions(spark, root), keep

    def _now(self) -> tuple[int, dict]:
        now = self.versions.current()
        return (now.number, now.content) if now else (0, EMPTY)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], MONITORING_SCHEMA)
        return self.spark.read.schema(MONITORING_SCHEMA).parquet(*[self.versions.path(f) for f in folders])

    def _commit(self, number: int, content: dict) -> None:
        folders = [*content["deltas"], *content["archive"], *([content["snapshot"]] if content["snapshot"] else [])]
        self.versions.commit(number, content | {"folders": folders})
        self.versions.vacuum(self.keep)

    def append(self, rows: DataFrame) -> None:
        """Add rows; they are visible all at once."""
        folder = self.versions.new_folder("delta")
        rows.select(*MONITORING_COLUMNS).write.parquet(self.versions.path(folder))
        while True:
            number, now = self._now()
            try:
                return self._commit(number + 1, now | {"deltas": [*now["deltas"], folder]})
            except Conflict:  # another append or a compaction came first: add to what it left
                continue

    def _state_rows(self, now: dict) -> DataFrame:
        return self._read([*([now["snapshot"]] if now["snapshot"] else []), *now["deltas"]])

    def state(self) -> DataFrame:
        """The newest row or rows of every turbine."""
        return D.latest_log_rows(self._state_rows(self._now()[1]))

    def history(self) -> DataFrame:
        """All rows ever appended, those without a turbine included."""
        now = self._now()[1]
        return self._read([*now["archive"], *now["deltas"]])

    def compact(self) -> bool:
        """Fold the deltas into a new snapshot and one folder of the archive.
        Appends that come meanwhile stay deltas behind it. False, and nothing
        changed, if there is nothing to fold or another compaction was faster."""
        number, now = self._now()
        folded = now["deltas"]
        if not folded:
            return False
        snapshot, archive = self.versions.new_folder("snapshot"), self.versions.new_folder("archive")
        (D.latest_log_rows(self._state_rows(now)).select(*MONITORING_COLUMNS)
         .sortWithinPartitions("turbine_id").write.parquet(self.versions.path(snapshot)))
        # the rows stay in their order, so nothing is shuffled: a task takes whole
        # deltas or runs of one, and each writes a file
        size = sum(files.modified(self.spark, self.versions.path(f))[1] for f in folded)
        self._read(folded).coalesce(max(1, -(-size // ARCHIVE_FILE_BYTES))).write.parquet(self.versions.path(archive))
        while True:
            number, now = self._now()
            if now["deltas"][:len(folded)] != folded:
                return False
            try:
                self._commit(number + 1, {"snapshot": snapshot, "deltas": now["deltas"][len(folded):],
                                          "archive": [*now["archive"], archive]})
                return True
            except Conflict:
                continue
