"""What can go wrong, by name."""


class LodeseekError(Exception):
    """Base of all errors of this package."""


class RepositoryNotFoundError(LodeseekError):
    """No such folder."""


class InvalidCommitError(LodeseekError):
    """A commit or version that can't be resolved."""


class UnsupportedLanguageError(LodeseekError):
    """A file whose suffix names no known language."""


class EmptyQueryError(LodeseekError):
    """A query without text."""


class MissingEmbeddingsError(LodeseekError):
    """Vectors of another encoder, or of none."""


class ModelLoadError(LodeseekError):
    """An encoder that can't be loaded."""


class IndexNotFoundError(LodeseekError):
    """A version that was never indexed."""
