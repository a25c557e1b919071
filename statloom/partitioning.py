"""Spreading of narrow scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of at most so many bytes is small enough to be dealt out anew.
SMALL_BYTES = 256 << 20
#: Beyond this the planner has no estimate, as for a batch of a stream.
_UNKNOWN = 1 << 60


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a small scan that leaves cores idle, by ``keys`` themselves, so that a join on them needs no second shuffle.

    A file with one row group is one busy task, whatever number of partitions
    it counts as; so a scan with fewer partitions than cores is dealt out anew
    if the planner's estimate of its bytes is small.  Any other scan stays as it
    is, as does one without an estimate that has a partition for half of the cores.
    Pass a scan with filters and projections only: asking a plan with shuffles
    for its partitions runs them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    partitions = scan.rdd.getNumPartitions()
    if partitions >= cores:
        return scan
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES and (size < _UNKNOWN or 2 * partitions > cores):
        return scan
    return scan.repartition(cores, *keys)
