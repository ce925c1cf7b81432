"""Analytics for draft and sealed card formats as PySpark jobs: table in, table out."""
