"""Finding, validating, masking and reporting sensitive values in text with Spark DataFrames."""
