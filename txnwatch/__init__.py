"""txnwatch: transaction risk scoring and monitoring on Spark.

Subpackages
-----------
sources    readers and writers: test tables, fixture views, the monitoring store
functions  column expressions: keyed draws, scalar helpers, rule table, risk scoring
operators  DataFrame operators: rolling windows, prefix sums, sampling, quality
           checks, joins, metrics, feature encoding, classifier, isolation forest
plans      query plans built from the operators: monitoring SQL, dashboard, training
streaming  Structured Streaming forms of live scoring and the daily trend

Every public function takes and returns DataFrames (or Columns) and leaves
paths to the caller.
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
