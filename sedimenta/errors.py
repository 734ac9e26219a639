"""Errors of the engine."""


class EngineError(Exception):
    """Anything the engine refuses to do."""


class QueryError(EngineError):
    """A statement that cannot be planned or run."""


class SessionLost(EngineError):
    """A session that is unknown, expired or closed."""


class IngestError(EngineError):
    """Input that does not fit its declaration."""


class SchemaConflict(IngestError):
    """A run whose fields are not those of the dataset."""


class BudgetExceeded(QueryError):
    """A plan whose estimated size is over the session's share of memory."""
