"""Exceptions. All carry what is known about the place of the fault in their attributes."""

from __future__ import annotations


class XylemError(Exception):
    """Base of all; keyword arguments become attributes and are told in the message."""

    def __init__(self, message: str, **about):
        self.about = {k: v for k, v in about.items() if v is not None}
        self.__dict__.update(about)
        super().__init__(message + "".join(f"\n  {k}: {v}" for k, v in self.about.items()))


class ParseError(XylemError):
    """Malformed markup (line, column, source)."""


class ValidationError(XylemError):
    """A name, comment, declaration or such that markup can't hold."""


class NamespaceError(XylemError):
    """A bad prefix or URI."""


class SerializationError(XylemError):
    """Nodes that don't make a document."""


class DocumentStructureError(XylemError):
    """An operation that would break the tree, a second root for one."""


class AttributeAccessError(XylemError):
    """An attribute operation on a node that has none."""


class BackendError(XylemError):
    """An unknown scanner."""


class UnsupportedError(XylemError):
    """Something the engine doesn't do."""


class XPathError(XylemError):
    """Base of the query errors (expression)."""


class XPathSyntaxError(XPathError):
    """(expression, position, token)"""


class XPathEvaluationError(XPathError):
    """An expression without a meaning here, as count() of a number."""


class XPathFunctionError(XPathError):
    """An unknown function, or a wrong number of arguments."""


class XPathNodeTypeError(XPathError):
    """A value where a node-set is needed."""


class XPathContextError(XPathError):
    """position() or last() outside a predicate, an unbound variable or prefix."""
