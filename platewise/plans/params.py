"""Parameters the registered queries use on the driver's test tables.

The test orders run from 1995-01 to 2001-08, so the reference's own dates
(2024) and horizons would select nothing; these values keep every query
informative on that data.  Library defaults keep the reference's values.
"""

# Parameters chosen for the test tables.
ANALYSIS_DATE = "2001-12-31"
EXPERIMENT = "SPRING20"
ENROLL_START = "1999-01-01"
ENROLL_END = "1999-02-01"
CONV_DAYS = 180
GMV_DAYS = 365
LAUNCH = "1999-01-01"
LOOKBACK_DAYS = 730
MIN_PRE_ORDERS = 2
