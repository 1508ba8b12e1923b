"""Model files of the legacy and modern library: ``models/*.ts[x]`` and the two interface files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEGACY, MODERN
from .files import SUFFIXES, listed

# Files of interfaces beside the models directory.
INTERFACES = ("interfaces.ts", "interfaces.codegen.ts")


def model_files(spark: SparkSession, shared: str, shared_2023: str, models_subdir: str = "models") -> DataFrame:
    """(path, content, source, seq); what is missing is left out, sub-directories of the models are too."""
    paths, rows = [], []
    for source, base in ((LEGACY, shared), (MODERN, shared_2023)):
        own = [os.path.join(base, n) for n in INTERFACES]
        directory = os.path.join(base, models_subdir)
        if os.path.isdir(directory):
            own += sorted(os.path.join(directory, n) for n in os.listdir(directory) if n.endswith(SUFFIXES))
        own = [p for p in own if os.path.isfile(p)]
        rows += [(p, source, len(rows) + i) for i, p in enumerate(own)]
        paths += own
    of = spark.createDataFrame(rows, "p string, source string, seq bigint")
    return listed(spark, paths).where("content IS NOT NULL").join(of, F.col("path") == F.col("p")).select("path", "content", "source", "seq")
