"""PySpark operators for intra-host variant data."""
