"""vellum: web-page and tabular sources to clean, evidence-backed entity records, on PySpark DataFrames."""
