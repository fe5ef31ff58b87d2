"""lapsekit: subscription-churn analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
dict of literals for fitted statistics).  Nothing is collected to the driver
except bounded summaries (fitted medians, quantile cut points, a few
coefficients).
"""

from lapsekit.spec import ObservationSpec, DEFAULT_SPEC, TESTDATA_SPEC

__all__ = ["ObservationSpec", "DEFAULT_SPEC", "TESTDATA_SPEC"]
