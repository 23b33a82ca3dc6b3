"""pertinax — encounter-pertinence analytics as composable Spark DataFrame transforms.

Sub-packages:

* ``sources``   — scans and sinks (CSV/Parquet/JSON tables, predictions, model store)
* ``functions`` — column expressions: cleaning parsers, clinical features, decree rules
* ``operators`` — DataFrame -> DataFrame operators: projections, joins, aggregates,
  profiling, metrics, ML preparation, models, scoring, error analysis
* ``plans``     — composed end-to-end plans (flagship query, training, bulk scoring)
  and the query registry used by ``__spark_entry__``
* ``streaming`` — Structured Streaming scoring of arriving encounter records
"""

__version__ = "0.1.0"
