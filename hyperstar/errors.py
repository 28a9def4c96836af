"""What can go wrong, split by who can mend it: the user of a request, or the maintainer of a model or store."""

from __future__ import annotations


class HyperstarError(Exception):
    """Any error of this library."""

    kind = "error"


class UserError(HyperstarError):
    """The request is wrong."""


class InternalError(HyperstarError):
    """The model, the configuration or the library is wrong."""

    kind = "internal_error"


class ArgumentError(UserError):
    kind = "argument_error"


class HierarchyError(UserError):
    """A path or level does not fit its hierarchy."""

    kind = "hierarchy_error"


class NotAuthorized(UserError):
    kind = "not_authorized"


class MissingObjectError(UserError):
    """A name that nothing goes by."""

    kind = "missing_object"
    what = "object"

    def __init__(self, name, reason: str = ""):
        self.name = name
        super().__init__(f"unknown {self.what} '{name}'" + (f": {reason}" if reason else ""))


class NoSuchCubeError(MissingObjectError):
    what = "cube"


class NoSuchDimensionError(MissingObjectError):
    what = "dimension"


class NoSuchAttributeError(MissingObjectError):
    what = "attribute"


class NoSuchTableError(MissingObjectError):
    what = "table"


class ExpressionError(UserError):
    kind = "expression_error"


class ModelError(InternalError):
    kind = "model_error"


class ModelInconsistencyError(ModelError):
    """Parts of a model contradict each other."""


class MappingError(ModelError):
    """An attribute has no place in the physical tables."""


class TemplateRequired(ModelError):
    """A dimension builds on a template that is not there yet."""

    def __init__(self, template: str):
        self.template = template
        super().__init__(f"template dimension '{template}' is required")


class ConfigurationError(InternalError):
    kind = "configuration_error"


class StoreError(InternalError):
    kind = "store_error"
