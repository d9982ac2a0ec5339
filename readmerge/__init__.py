"""Merging of overlapping paired-end sequencing reads on Spark."""

__version__ = "0.3.0"
#: Version of the interface of modules.
API_VERSION = 3
#: Longest read that the command lines accept as a trim.
MAX_LEN = 450


def default_parallelism() -> int:
    """Tasks that the session runs at once (workers of a pool have no other counterpart)."""
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate().sparkContext.defaultParallelism
