"""skein: code-graph retrieval and analytics on Spark DataFrames."""
