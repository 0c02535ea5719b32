"""Errors raised by the library."""


class LorelineError(Exception):
    """Base of all errors of this library."""


class IndexNotFound(LorelineError):
    """No committed index version under the given folder."""


class GraphChecksumError(LorelineError):
    """A stored graph does not match its manifest."""


class CommitConflict(LorelineError):
    """Another job has committed the version that this one was about to commit."""
