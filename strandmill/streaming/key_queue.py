"""A first-in-first-out queue of keys as a stateful stream, with an inverted index of k-mers kept in step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that such streams need; set it as ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "queue string, number long, slot int, sequence string, replaced string, candidates array<int>"


class KeyQueue(StatefulProcessor):
    """A ring of ``size`` slots for each queue.

    State: the next slot, the sequence of every slot, and for every k-mer the slots whose sequence holds it.
    A key that arrives first learns which slots share a k-mer with it, then takes the next slot,
    and the index forgets the key that was there.
    """

    def __init__(self, size: int, k: int):
        self.size, self.k = size, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "slot int")
        self.slots = handle.getMapState("slots", "slot int", "sequence string")
        self.index = handle.getMapState("index", "kmer string", "slots array<int>")

    def _kmers(self, sequence: str) -> set[str]:
        return {sequence[i : i + self.k] for i in range(len(sequence) - self.k + 1)}

    def _held(self, kmer: str) -> list[int]:
        return list(self.index.getValue((kmer,))[0]) if self.index.containsKey((kmer,)) else []

    def _forget(self, slot: int, sequence: str) -> None:
        for kmer in self._kmers(sequence):
            left = [s for s in self._held(kmer) if s != slot]
            if left:
                self.index.updateValue((kmer,), (left,))
            else:
                self.index.removeKey((kmer,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot = self.next.get()[0] if self.next.exists() else 0
        out = []
        batch = pd.concat(list(rows)).sort_values("number")  # a micro-batch of one queue
        for number, sequence in zip(batch["number"], batch["sequence"], strict=True):
            near = sorted({s for kmer in self._kmers(sequence) for s in self._held(kmer)})
            old = self.slots.getValue((slot,))[0] if self.slots.containsKey((slot,)) else None
            if old is not None:
                self._forget(slot, old)
            self.slots.updateValue((slot,), (sequence,))
            for kmer in self._kmers(sequence):
                self.index.updateValue((kmer,), (sorted({*self._held(kmer), slot}),))
            out.append((key[0], int(number), slot, sequence, old, near))
            slot = (slot + 1) % self.size
        self.next.update((slot,))
        yield pd.DataFrame(out, columns=["queue", "number", "slot", "sequence", "replaced", "candidates"])

    def close(self) -> None:
        pass


def enqueue(keys: DataFrame, size: int, k: int) -> DataFrame:
    """(queue, number, slot, sequence, replaced, candidates) of a stream keys(queue, number, sequence), in order of number within a queue.

    What a key gets depends on the keys before it and not on how the stream is cut into batches, as long as numbers ascend from batch to batch.
    """
    own = keys.select(F.col("queue").cast("string").alias("queue"), F.col("number").cast("long").alias("number"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    return own.groupBy("queue").transformWithStateInPandas(KeyQueue(size, k), OUTPUT, "Append", "None")


def queue_of(log: DataFrame) -> DataFrame:
    """(queue, slot, number, sequence): what each slot holds at the end of a log of ``enqueue``."""
    last = log.groupBy("queue", "slot").agg(F.max(F.struct("number", "sequence")).alias("m"))
    return last.select("queue", "slot", "m.*")
