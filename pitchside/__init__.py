"""pitchside — match analytics as lazy Spark DataFrame operators.

Every public operator takes and returns a DataFrame; nothing is collected
on the data path.  Sub-packages:

* ``sources``   – scans of season CSVs, the match store, fixture/odds payloads
* ``operators`` – rolling team form, odds enrichment, upsert, metrics, reports, models
* ``functions`` – column-expression helpers (null-safe inverses, formatting, JSON)
* ``plans``     – composed flows, the test views over the driver tables, the query registry
* ``streaming`` – incremental fixture ingest with Structured Streaming
"""

__version__ = "0.1.0"
