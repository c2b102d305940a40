"""debuglens: debugging-symbol analytics expressed as Spark DataFrames."""
