"""Message-triage analytics on Spark DataFrames."""
