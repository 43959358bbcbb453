"""Errors that callers can tell apart."""


class DataError(ValueError):
    """The input breaks a rule that the operator relies on."""


class ConfigError(ValueError):
    """A setting is out of range or contradicts another."""
