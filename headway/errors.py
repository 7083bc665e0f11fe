"""Refusals, by what was wrong; messages say what to do."""


class SchemaMismatchError(ValueError):
    """A table's columns are not those that an operator was written for."""


class LeakageError(ValueError):
    """A feature would tell the model its answer."""


class StaleIndexError(ValueError):
    """An index was built from other passages, or by another embedder."""


class FeedError(RuntimeError):
    """A feed message can't be read."""


class EmbeddingError(RuntimeError):
    """An embedder returned another number or width of vectors."""


class RefusedError(RuntimeError):
    """A language model declined to answer."""
