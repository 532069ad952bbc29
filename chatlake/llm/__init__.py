"""Operators for LLM text: nothing outside this folder imports it."""
