"""Point-in-time time-series analytics expressed as PySpark DataFrame operators.

The session time zone must be UTC (see :func:`knownwhen.session.utc_session`): wall-clock
columns are ``TIMESTAMP_NTZ`` and elapsed-time arithmetic is done on UTC microseconds.
"""

__version__ = "0.1.0"
