"""studylake: tables out of large collections of study documents, on Spark."""
