"""Using all cores on inputs that come in few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a scan with fewer splits than the cluster has cores.

    For per-row work that costs far more than moving the rows: parsing pages,
    cleaning texts. A table of many files already has more splits than cores and
    is returned as it is, without a shuffle. ``scan`` must be a plain read, whose
    split count is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
