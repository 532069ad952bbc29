"""chatlake: a PySpark-native engine for exported LLM conversation logs."""

__version__ = "0.1.0"
