"""shoplane: repair-shop work-order analytics as Spark DataFrame operators.

Sub-packages
------------
sources    -- readers/writers (Parquet, exported sheets, brand dictionary, models)
functions  -- Column-level scalar expressions (text, dates, coercion, JSON)
operators  -- DataFrame operators (filters, joins, ordered windows, metrics,
              brand matching, note splitting, ML feature stages)
plans      -- end-to-end batch jobs (merge, clean, train, evaluate, score)
streaming  -- stateless operators applied to streaming DataFrames
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions and classes by value, so Python
    workers (UDF, mapInPandas) run them without the package being installed
    on executors."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 -- older cloudpickle: ship with --py-files
        pass


_ship_by_value()
