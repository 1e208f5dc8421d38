"""corpusloom: Spark-first operators for evidence-grounded text corpora."""
