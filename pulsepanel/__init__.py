"""pulsepanel — customer-period panel analytics on Spark DataFrames.

Raw activity / payment / membership tables become one row per
(customer, period); on that panel the library builds calendar-aware lag and
difference features, forward churn labels with a per-period trust verdict,
out-of-time splits, distributed model scoring, exact top-k campaign metrics,
profiles, segments and scenario grids.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, so Catalyst plans, prunes and pushes down the whole chain.
"""

from pulsepanel.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
