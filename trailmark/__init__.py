"""Point-in-time behavioural features, screening and alert rules on Spark DataFrames."""
