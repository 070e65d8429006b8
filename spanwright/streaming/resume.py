"""Generation that can be cut off and resumed: keyed state remembers what is done and which verdicts are pinned.

Events are questions and pins, keyed by question. A question is answered once, whatever repeats of it come in later files or
runs; a pinned verdict wins over the screen's, where it came before the answer. The state lives in the stream's checkpoint, so
two runs over it give what one run over all files gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: An event: ``pin`` is null for a question, ``risky`` and ``question`` are null for a pin; ``nth`` orders the events of a question.
EVENTS = "question_id string, nth long, question string, risky boolean, pin boolean"
DECIDED = "question_id string, question string, risky boolean, pinned boolean"


class Decide(StatefulProcessor):
    """The first question of a key, with its pin or the screen's verdict; nothing for what is done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pin = handle.getValueState("pin", "pin boolean")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values("nth", kind="stable")
        pins = frame[frame["pin"].notna()]
        if len(pins):  # a pin of this batch holds for its questions too
            self.pin.update((bool(pins["pin"].iloc[-1]),))
        asked = frame[frame["pin"].isna()]
        if not len(asked) or self.done.exists():
            return
        self.done.update((True,))
        first = asked.iloc[0]
        pinned = self.pin.exists()
        risky = self.pin.get()[0] if pinned else bool(first["risky"])
        yield pd.DataFrame({"question_id": [key[0]], "question": [first["question"]], "risky": [bool(risky)], "pinned": [pinned]})

    def close(self) -> None:
        pass


def decided(events: DataFrame) -> DataFrame:
    """(question_id, question, risky, pinned) of a stream of ``EVENTS``: each question once. Events without a key are left out."""
    keyed = events.filter(F.col("question_id").isNotNull()).groupBy("question_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Decide(), outputStructType=DECIDED, outputMode="Append", timeMode="None")


def generate(events: DataFrame, answered, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Answers the undone questions of the stream to Parquet at ``path``; ``answered`` maps the decided questions to what is written.

    By default it takes what is there and ends. ``checkpoint`` carries the state from run to run.
    """
    conf = events.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        out = answered(decided(events)).writeStream.format("parquet").option("path", path).outputMode("append")
        return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
