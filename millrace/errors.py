"""Exceptions raised by the engine."""


class MillraceError(Exception):
    """Base of every error raised here."""


class InvalidInput(MillraceError):
    """A key, value, name or query text is not acceptable."""


class InvalidOperation(MillraceError):
    """The call is not possible in the present state."""


class NotFound(MillraceError):
    """A named table, index or snapshot does not exist."""


class TransactionError(MillraceError):
    """A transaction cannot go on."""


class ConflictError(TransactionError):
    """Another transaction committed a change to the same key first."""


class CorruptionError(MillraceError):
    """Stored data does not match its checksum or count."""


class LexerError(InvalidInput):
    """The query text holds a sign or literal that is not in the language."""


class ParseError(InvalidInput):
    """The query text does not follow the grammar."""


class PlanError(InvalidInput):
    """The query names something that its tables do not have."""
