"""Evidence that keeps arriving (survey 2.12, A17, B2): new files of a folder go into a case, each once, also over crashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import CaseSession
from ..sources.ingest import facts_of

BINARY = "path string, modificationTime timestamp, length long, content binary"


def intake(session: CaseSession, folder: str, checkpoint: str, name: str = "files", files_a_batch: int = 1000, after: Callable[[str], None] = lambda _: None) -> StreamingQuery:
    """Starts a stream over what is in the folder, and ends with it; run again, it takes what is new.

    A batch that was cut off is run again with the same files. Its first event id and number of events were noted
    before any event was appended, so that the same events get the same ids, and only those that aren't there are
    appended. after is called with the name of each step once it is done.
    """

    def put(files: DataFrame, batch: int) -> None:
        session.ingest_batch(files, name, batch, after)

    files = session.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return facts_of(files).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
