"""tabulith: a Spark-first engine for document retrieval, table question answering and answer evaluation."""
