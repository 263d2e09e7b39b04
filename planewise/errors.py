"""Errors of the engine."""


class ImportValidationError(ValueError):
    """An imported matrix is unusable; the message names the rule and the first rows that break it."""


class CompatibilityError(ValueError):
    """A metric, view or record doesn't belong to the representation it is used with."""


class BundleError(ValueError):
    """A bundle is missing parts or fails its checks."""
