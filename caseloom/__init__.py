"""caseloom: complaint-text and document analytics expressed as Spark DataFrames."""
