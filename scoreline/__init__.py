"""scoreline — contest analytics (two-sided matches, entities, market values) as
PySpark DataFrame operators.

Layout:
  functions/  Column-expression helpers (text, numbers, money, urls, flags).
  sources/    Readers and sinks: driver tables, stand-in views, layers, CSV/JSON/GeoJSON,
              literal dimensions.
  operators/  DataFrame -> DataFrame transformations (cleaning, facts, marts,
              analytics, standings, profile/radar, photo cache, data quality).
  plans/      Query registry used by ``__spark_entry__`` and ``bench.py``.
  llm/        Training-data pipeline operators; nothing else imports them.
"""

__version__ = "0.1.0"
