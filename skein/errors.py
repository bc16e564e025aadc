"""Errors of the engine; each names what a caller can act on."""

from __future__ import annotations


class SkeinError(Exception):
    """Base of all."""


class SchemaError(SkeinError):
    """The schema text is wrong, or contradicts itself."""


class QuerySyntaxError(SkeinError):
    """The query text does not follow the grammar."""


class QueryTypeError(SkeinError):
    """A literal or predicate does not fit the field's type."""


class InvalidArgument(SkeinError):
    """A name or argument that the schema does not know."""


class ObjectNotFound(SkeinError):
    """``get`` of an id that is not there."""


class UniqueViolation(SkeinError):
    """Two objects would share a unique value."""


class DeleteDenied(SkeinError):
    """An object is still referred to by a field with ``@on_delete(deny)``."""


class PermissionDenied(SkeinError):
    """No rule allows the operation."""


class BudgetExceeded(SkeinError):
    """The query passes a limit of the governor."""


class TextQueryError(SkeinError):
    """The text of ``.matches`` is wrong or too long."""


class IdCollision(SkeinError):
    """An import brings an id that is there already."""


class ConflictError(SkeinError):
    """Another writer has committed since the snapshot was taken."""


class MigrationError(SkeinError):
    """A migration cannot be applied."""
