"""proofloom: a Spark-first engine that audits large collections of documents."""
