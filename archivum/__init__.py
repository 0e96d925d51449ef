"""archivum: a Spark-native engine for file-format registries and their data pipelines."""

__version__ = "0.1.0"
