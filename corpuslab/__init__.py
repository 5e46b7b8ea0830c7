"""corpuslab: corpus preparation and comparison as Spark DataFrame jobs.

Layout:
  functions/  Column -> Column building blocks (cleaning, strip, byte ids, md5 draws)
  operators/  DataFrame -> DataFrame operators (filters, explode, order, tokens, metrics, stats)
  sources/    readers and writers (dump XML, JSON lines, text lines, runs TSV, shards, reports)
  plans/      end-to-end jobs and the derived views used by tests and the bench
  streaming/  the stateless cleaning chain on a readStream
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (on any executor)
    run our UDF helpers without the package being installed there."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
