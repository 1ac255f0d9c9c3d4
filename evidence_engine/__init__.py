"""Evidence curation and grounded-QA auditing on Spark DataFrames."""
