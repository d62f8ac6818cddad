"""cohortspark: cohort finding in free-text reports, evaluated and audited, on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates and windows.  Sub-packages:

* ``sources``   – readers, writers and the canonical report view over test tables
* ``functions`` – Column-expression builders (statistics, text patterns, formats, JSON)
* ``operators`` – the operator library (prep, roll-up, metrics, fairness, matching, ...)
* ``plans``     – end-to-end cohort compositions and the query registry
* ``streaming`` – stateless operators applied to streaming DataFrames
"""

from cohortspark.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
