"""Operators for training-data pipelines: near-duplicates, personal data,
quality, token counts, mixing and packing, as Spark jobs.

Nothing else in the package imports this one. Its Python functions travel to
the workers by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
