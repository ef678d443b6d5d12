"""codecorpus: PySpark operators for corpora of source-code repositories."""
