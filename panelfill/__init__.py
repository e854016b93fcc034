"""Panel survey imputation as Spark DataFrame jobs."""
