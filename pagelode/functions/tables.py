"""Reading of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

PIECE_ROWS, PIECE_BYTES = 1024, 2 << 20


def pieces(batches, rows: int = PIECE_ROWS, size: int = PIECE_BYTES):
    """Arrow batches cut into runs of their rows, in order: of so many rows and, by the batch's mean, so many bytes at most, but of a row at least. What is
    made of a row as Python objects is several times its size; so it stands for a piece at a time, whatever the batches are."""
    for batch in batches:
        step = max(1, min(rows, len(batch) * size // max(1, batch.nbytes)))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read from files, dealt out anew if it has fewer files than there are cores: the rows of a file that is one row group are one
    task's, which costs more than to move them where each of them takes long. What has many splits is left as it is. Rows are the same."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    few = len(table.inputFiles()) < cores and table.rdd.getNumPartitions() <= 2 * cores
    return table.repartition(cores) if few else table
