"""Exceptions raised by the package."""


class TieoutError(Exception):
    """Base of every error raised here."""


class ArgumentError(TieoutError, ValueError):
    """A call that cannot mean anything: wrong digits, a bare string operand, no order given."""


class DuplicateKeyError(TieoutError):
    """A key expected to identify a row does not."""


class UnknownPatternError(TieoutError):
    """A formula shape or function with no defined column meaning."""


class RenderError(TieoutError):
    """A statement could not be written out as SQL text."""


class ReadError(TieoutError):
    """A delivery could not be read."""


class ContractError(TieoutError):
    """A contract is malformed, or a delivery breaks it."""


class NotConvergedError(TieoutError):
    """An iterative operator reached its round limit; no partial result is returned."""
