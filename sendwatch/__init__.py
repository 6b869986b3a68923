"""sendwatch: unwanted-messaging risk analytics expressed as Spark jobs.

Layers:
  sources/    driver tables -> typed message / complaint / account views; sinks
  functions/  column expressions: predicates, calendar helpers, rates
  operators/  reusable relational building blocks (top-1 per group, shares,
              tile cut points, interval join, profiling stats, exact KNN)
  plans/      the end-to-end jobs (account rates, suspensions, weekly tables,
              traits, complaints, feature assembly, profiling, models, risk)
  streaming/  incremental (Structured Streaming) form of the weekly rollup
"""

from sendwatch.config import Period, Params, DEFAULT_PARAMS  # noqa: F401
from sendwatch.session import get_spark, ensure_checkpoint_dir  # noqa: F401
