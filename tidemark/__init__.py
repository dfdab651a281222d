"""tidemark: audit, sample, score and track labelled text data that ages, on Spark DataFrames."""
