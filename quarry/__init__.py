"""quarry: project-metadata analytics on Spark DataFrames."""
