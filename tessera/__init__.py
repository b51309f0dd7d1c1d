"""A PySpark library for multi-client data preparation, splits, audits and scores."""
