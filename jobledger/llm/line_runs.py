"""Lines that many documents share: levelled sorted runs of line hashes.

The state is a set of runs, as in a log-structured merge tree: stored tables of (hash, number of documents, holder), sorted
by hash. A batch of lines is counted, merge-anti-joined with all runs, and added as a run of its own: keys that no run has
get a holder, the batch's largest document; known keys only add to the count. When a level has ``FAN_IN`` runs, they are
merged into one run of the next level, so there are about ``FAN_IN`` times log(batches) runs and each key is rewritten once
per level. Runs hold no texts: 40 bytes per different long line.

A hash is 128 bits of XXH3, so different lines are told apart at any realistic size. Batches that come in falling order
of ids make the holder the largest document of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.common import attach, doc_key, over_batches, settle, text_tag, texts

FAN_IN = 3
BATCHES = 6
# A run has a file for so many lines of its batch.
ROWS_PER_FILE = 500_000
HASH = ["h1", "h2"]


class LineRuns:
    """The state: ``levels[i]`` is a list of runs, the newest last, each with its number of files."""

    def __init__(self) -> None:
        self.levels: list[list[tuple[DataFrame, int]]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    @staticmethod
    def _write(rows: DataFrame, files: int) -> DataFrame:
        return settle(rows.coalesce(files).sortWithinPartitions(*HASH), "line-run")

    def add(self, lines: DataFrame) -> None:
        """``lines``: ``h1, h2, key``; a document must be in one batch only."""
        files = max(1, -(-lines.count() // ROWS_PER_FILE))
        # Documents first: a line that very many documents have is spread over them until it is counted.
        counted = lines.select(*HASH, "key").distinct().groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("key").alias("holder"))
        # Anti-join as a left join, so that known and new keys come out of one pass over the runs.
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            counted = counted.join(run.select(*HASH, F.lit(True).alias(f"in_{i}")).hint("merge"), HASH, "left")
            known = known | F.col(f"in_{i}").isNotNull()
        run = counted.select(*HASH, "n_docs", F.when(~known, F.col("holder")).alias("holder"))
        self.levels[0].append((self._write(run, files), files))
        for i, level in enumerate(self.levels):
            if len(level) >= FAN_IN:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                files = sum(n for _, n in level)
                self.levels[i + 1].append((self._write(self._merged([run for run, _ in level]), files), files))
                self.levels[i] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Merge joins of sorted runs."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select(*HASH, F.col("n_docs").alias("n_more"), F.col("holder").alias("other")).hint("merge")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
            out = out.join(other, HASH, "full").select(*HASH, n_docs.alias("n_docs"), F.greatest("holder", "other").alias("holder"))
        return out

    def state(self) -> DataFrame:
        """One row per key: ``h1, h2, n_docs, holder``."""
        return self._merged(self.runs())


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def long_lines(docs: DataFrame, least: int, doc_id: str, text: str) -> DataFrame:
    """``key, tag, line`` (number from 0) and hash of each line whose key has at least ``least`` code points."""
    rows = docs.select(doc_key(doc_id).alias("key"), text_tag(text).alias("tag"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            row, number, hashes = [], [], []
            for i, content in enumerate(texts(batch.column(2))):
                for n, line in enumerate(content.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                        row.append(i), number.append(n), hashes.append(xxhash.xxh3_128_digest(key))
            found = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            taken = pa.array(row, pa.int32())
            columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(number, pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "tag", "line", "h1", "h2"])

    return rows.mapInArrow(run, "key long, tag binary, line int, h1 long, h2 long")


def drop_shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines are what ``\\n`` separates; null and empty texts have one empty line. Lines whose key (stripped, A-Z lower-cased)
    has ``least_chars`` code points and is in ``least_docs`` documents go everywhere but in the largest id that has it.
    Rows with equal ids are one document.
    """
    low, high = docs.agg(F.min(F.col(doc_id)), F.max(F.col(doc_id))).first()
    width = (high - low) // batches + 1 if low is not None else 1
    number = F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((F.lit(high or 0) - F.least("key", F.lit(high or 0))) / F.lit(width)))).cast("int")
    lines = settle(long_lines(docs, least_chars, doc_id, text).withColumn("batch", number), "lines")
    runs = LineRuns()
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i))
    shared = runs.state().where(F.col("n_docs") >= least_docs)
    gone = lines.join(shared, HASH).where("key <> holder").groupBy("key", "tag").agg(F.collect_set("line").alias("__gone"))
    keyed = docs.withColumns({"__key": doc_key(doc_id), "__tag": text_tag(text)})
    noted = attach(keyed, gone.withColumnsRenamed({"key": "__key", "tag": "__tag"}), ["__key", "__tag"])
    at, marks = noted.columns.index(text), noted.columns.index("__gone")

    def compute(batch):
        n_lines, n_dropped, kept = [], [], []
        for content, gone in zip(texts(batch.column(at)), batch.column(marks).to_pylist()):
            own = content.split(b"\n")
            n_lines.append(len(own)), n_dropped.append(len(gone or ()))
            if gone:
                gone = set(gone)
                content = b"\n".join([line for i, line in enumerate(own) if i not in gone])
            kept.append(content)
        return [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    return over_batches(noted, added, compute).drop("__key", "__tag", "__gone")
