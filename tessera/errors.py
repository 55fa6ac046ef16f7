"""Errors and the exit codes they map to."""


class TesseraError(Exception):
    exit_code = 3


class UsageError(TesseraError):
    """The call itself is wrong."""

    exit_code = 2


class EmptyQueryError(UsageError):
    """A query without any text."""


class DataError(TesseraError):
    """Stored or given data cannot be used."""


class ConflictError(TesseraError):
    """Another writer holds the collection, or has published meanwhile."""

    exit_code = 4
