"""Session settings the reports are meant to run with on a cluster.

Pass them to the session builder. ``spark.checkpoint.dir`` names the shared folder
and comes from the cluster.
"""

CLUSTER = {
    # Joins: sizes are checked again at run time, hot partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffles: start with many partitions, then merge them to this size.
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Scans.
    "spark.sql.files.maxPartitionBytes": "256m",
    # Lost executors: finished work moves on, slow tasks run twice.
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.speculation": "true",
    # Wall-clock columns carry no zone.
    "spark.sql.session.timeZone": "UTC",
}
