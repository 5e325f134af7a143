"""vecfactor: latent-factor and word-vector analytics as Spark jobs.

Sub-packages:
    functions  column expressions (token predicates, vector arithmetic, names)
    sources    rating/word-list payload parsing, binary vector files, model store
    operators  flatten/validate ratings, ALS + scoring, centres, nearest word
    plans      fixtures derived from the driver tables and the registered queries
    streaming  file feeds that run the batch jobs per micro-batch
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions and classes by value.

    Python tasks (the nearest-word kernel, the per-model ALS, the vector-file
    data source) then run on executors that do not have the package on their
    path, e.g. when a job is started from another directory without
    ``--py-files``.
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
