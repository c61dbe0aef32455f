"""threadloom: Spark-native analytics over threaded conversations, authors, embeddings and text-model evaluations."""

__version__ = "0.1.0"
