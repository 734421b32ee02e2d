"""Custom stateful processing."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.groups import as_list

# Processors carry their code, so nothing needs installing on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def running_state(
    stream: DataFrame, by, processor: StatefulProcessor, schema: str, mode="update", times="None"
) -> DataFrame:
    """Run a stateful processor per `by` value; it sees a key's rows one by one, as Rows, and
    yields Rows. Keys with few rows are most of the work, and a data frame for each cost more
    than its state.

    `times` is the processor's time mode: "None", "ProcessingTime" or "EventTime".
    """
    return stream.groupBy(*as_list(by)).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=times
    )


def salted(stream: DataFrame, *columns: str, salts=4) -> DataFrame:
    """Add `salt` from a hash of `columns`, to spread the state of busy keys.

    Only for processors whose results can be added up over the salts of a key.
    """
    return stream.withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))


class RunningTotal(StatefulProcessor):
    """Rows and the sum of an amount per (key, salt) since the stream began."""

    def __init__(self, amount: str):
        self.amount = amount

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", "n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # None if there is no state yet: one call instead of two.
        n, total = self.state.get() or (0, 0.0)
        added = 0.0
        for row in rows:
            n, value = n + 1, row[self.amount]
            # Null and NaN are no amount.
            if value is not None and value == value:
                added += value
        total += added
        self.state.update((n, total))
        yield Row(key=key[0], salt=key[1], rows=n, total=total)

    def close(self) -> None:
        pass
