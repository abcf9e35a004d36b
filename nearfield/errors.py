"""Errors of this package; all are raised on the driver."""


class VectorSearchError(Exception):
    """Base of all errors here."""


class ConfigError(VectorSearchError, ValueError):
    """A parameter that can never work."""


class DataError(VectorSearchError, ValueError):
    """Vectors that do not fit what they are used for."""


class IndexStateError(VectorSearchError, RuntimeError):
    """An operation before the index was built."""


class BuildError(VectorSearchError, RuntimeError):
    """A construction that cannot finish."""


def require(ok: bool, message: str, kind: type[VectorSearchError] = ConfigError) -> None:
    if not ok:
        raise kind(message)
