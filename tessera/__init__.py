"""tessera: a Spark-native engine for object tracking, cluster quality and classification."""

__version__ = "0.1.0"
