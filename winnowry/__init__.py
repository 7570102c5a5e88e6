"""Content triage and training-data preparation on Spark DataFrames."""
