"""SQL statements to DataFrame plans."""

from .script import statements
from .sqlfront import SqlEngine, SqlError

__all__ = ["SqlEngine", "SqlError", "statements"]
