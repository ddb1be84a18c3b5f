"""corpusloom: a Spark-native engine for corpus preparation, vector retrieval and answer evaluation."""
