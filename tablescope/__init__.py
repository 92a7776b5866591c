"""tablescope: questions about tables, answered with Spark DataFrames."""
