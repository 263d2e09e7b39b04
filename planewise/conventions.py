"""Numeric conventions that all operators share."""

# Fixed values.
FISHER_RAO_SCALE = 2.0
CLR_DELTA = 1e-6
LOGIT_EPS = 1e-6
LOG_FLOOR = 1e-300
NATS_FLOOR = 1e-12
NEGATIVE_ATOL = 1e-9
PROB_SUM_ATOL = 1e-10
IMPORT_SUM_ATOL = 1e-3
FITTED_ORTHONORMAL_ATOL = 1e-10
IMPORTED_ORTHONORMAL_ATOL = 1e-5
MIN_SPREAD = 1e-8
STABLE_OVERLAP, VOLATILE_OVERLAP = 0.65, 0.35
BUNDLE_VERSION, SQLITE_VERSION, RECORD_VERSION = "0.1.0", "0.2.0-sqlite", "0.1.0"

#: Neighbours are ordered by distance rounded to so many places, then by id: equal distances differ in their last bits across plans.
ORDER_PLACES = 9
#: Places of a number that leaves a query.
RESULT_PLACES = 6
