"""ledgerloom: a PySpark-native engine for curating question-answering data and evaluating model answers."""

__version__ = "0.1.0"
