"""Scalar functions that SQL and the stream interface share."""

from .udf import Udf, UdfRegistry, regex_match, udf

__all__ = ["Udf", "UdfRegistry", "regex_match", "udf"]
