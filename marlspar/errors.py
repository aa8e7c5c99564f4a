"""Errors of the query engine; all are ValueErrors."""


class QueryError(ValueError):
    """A query that cannot run as asked."""


class ColumnNotFound(QueryError):
    """A named column that the file lacks."""


class FormatError(QueryError):
    """A file that is no Parquet, or holds what cannot be decoded."""
