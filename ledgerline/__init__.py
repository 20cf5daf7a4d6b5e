"""Point-in-time analytics over annual filings, expressed as Spark DataFrame plans."""
