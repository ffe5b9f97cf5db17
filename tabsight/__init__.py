"""tabsight: self-service analysis of tabular data on Spark.

Sub-packages: ``sources`` (scans, mount, ledger storage), ``functions``
(column expressions, exact quantiles, distinct bounds, balanced ranking),
``operators`` (profiling, shapes, chart data, manifest, routing,
conversation, ledger), ``plans`` (scripts, analysis plan, registered queries)
and ``streaming`` (ledger streams). ``session`` holds session defaults.
"""

__version__ = "0.1.0"
