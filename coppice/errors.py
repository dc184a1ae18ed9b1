"""Errors of loading and calling."""


class LoadError(Exception):
    """A model or configuration cannot be loaded."""


class ModelIOError(LoadError):
    """The file cannot be read."""


class MalformedModel(LoadError):
    """The model breaks its format."""


class MalformedConfig(LoadError):
    """The grouping configuration is not valid."""


class Unsupported(LoadError):
    """The model is valid but this engine does not score it."""


class LimitExceeded(LoadError):
    """The input is beyond a limit of LoadOptions."""
