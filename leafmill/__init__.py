"""Document-corpus analytics on Spark: paragraphs, runs, tokens and edits as DataFrames."""
