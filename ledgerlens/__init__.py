"""ledgerlens — periodic business reporting as Spark jobs.

Every table is keyed by ``(client, period)``; every check is a function from
DataFrames to a DataFrame of flags, so one job serves one client or thousands.

Sub-packages:

* ``sources``   — scans of messy exports, log readers and sinks
* ``functions`` — column expressions (number tokens, text cleaning, formats)
* ``operators`` — KPI snapshot, measures, thresholds, gate checks, profiling,
  drift, dates, golden values, audit, clean months, costs
* ``plans``     — the registered queries over the driver's test tables
* ``streaming`` — incremental snapshot of arriving exports
"""

__version__ = "0.1.0"
