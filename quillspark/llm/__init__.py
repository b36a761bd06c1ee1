"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from quillspark.llm._common import clear

__all__ = ["clear"]
