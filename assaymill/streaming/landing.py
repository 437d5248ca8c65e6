"""Progressive results: a landing folder of records, merged as files come.

Rows of a file may arrive over many batches; state is keyed by file and id, and
the last marker of a file (``complete``) emits its merged records.  Late rows
past the watermark are dropped with the state they belong to."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORDS = "file string, page int, rank int, compound_id string, assay string, value string, complete boolean, at timestamp"


def landed(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of record files, a few a batch."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def page_counts(records: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Records per file and time window, with a watermark."""
    return records.withWatermark("at", delay).groupBy(F.window("at", window), "file").agg(F.count(F.lit(1)).alias("records"), F.approx_count_distinct("page").alias("pages"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = {tuple(k): v for k, v in json.loads(state.get[0])} if state.exists else {}
    ended = False
    for part in batches:
        ended = ended or bool(part["complete"].fillna(False).any())
        for r in part[part["value"].fillna("") != ""].itertuples():
            k, v = (r.compound_id, r.assay), [int(r.page), int(r.rank), r.value]
            if k not in best or v < best[k]:
                best[k] = v
    if ended:
        if state.exists:
            state.remove()
        rows = [(key[0], c, a, v[2]) for (c, a), v in sorted(best.items())]
        yield pd.DataFrame(rows, columns=["file", "compound_id", "assay", "value"])
    else:
        state.update((json.dumps([[list(k), v] for k, v in best.items()]),))


def merged_on_completion(records: DataFrame) -> DataFrame:
    """``file, compound_id, assay, value`` of each file once it is complete:
    first filled value by page and rank, whatever order rows came in."""
    return records.groupBy("file").applyInPandasWithState(_fold, "file string, compound_id string, assay string, value string", "best string", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Runs a sink over each batch; ``stop()`` of the returned query cancels."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Progress(StreamingQueryListener):
    """Collects a record per batch: its number, rows and rows a second."""

    def __init__(self) -> None:
        self.records: list[dict] = []
        self.ended: str | None = None

    def onQueryStarted(self, event) -> None:
        self.ended = None

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.records.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = event.exception or "done"
