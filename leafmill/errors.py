"""Errors of the two text languages and of reading."""


class ParseError(ValueError):
    """A query, path or matcher that cannot be read."""

    def __init__(self, message: str, position: int, text: str) -> None:
        super().__init__(f"{message} at position {position}: {text!r}")
        self.message, self.position, self.text = message, position, text


class HeaderLengthError(ValueError):
    """A header with another number of names than the query has columns."""


class InvalidRecordError(ValueError):
    """Bytes that are not a record."""
