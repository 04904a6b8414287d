"""leadloom: a Spark-first lead-analytics engine."""
