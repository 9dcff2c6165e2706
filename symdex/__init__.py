"""symdex: retrieval and processing of source code and documents on Spark."""
