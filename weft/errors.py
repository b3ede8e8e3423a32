"""Errors raised by the library."""


class GraphError(ValueError):
    """Base of all errors below."""


class InvalidGraph(GraphError):
    """Columns are missing, ids repeat or edges point nowhere."""


class PatternError(GraphError):
    """A motif that can't be parsed or isn't supported."""

    def __init__(self, message: str, pattern: str):
        super().__init__(f"{message}: {pattern!r}")


class NoSuchVertex(GraphError):
    """A given id is not in the graph."""


class InvalidPropertyGroup(GraphError):
    """A property group is unknown, or its data don't fit."""


class UnsupportedVertexType(GraphError):
    """The algorithm can't handle ids of this type."""
