"""Range and outcome analytics over market bars, written as Spark jobs.

All ``*_minutes`` columns and parameters count bars; with the usual one-minute
bar they are minutes.  The bar length is the ``step_ms`` parameter everywhere.
"""
