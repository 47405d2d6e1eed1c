"""A Spark-native engine for pipeline queries (KQL) over batches, streams and records."""

from .api import Node, Options, Query, Schema, compile, function
from .errors import KqlCompileError, KqlError, KqlEvalError, KqlUnsupportedError

__version__ = "0.1.0"

__all__ = ["KqlCompileError", "KqlError", "KqlEvalError", "KqlUnsupportedError", "Node", "Options", "Query", "Schema", "__version__", "compile", "function"]
