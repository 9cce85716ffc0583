"""Errors with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package; `code` is stable."""

    code = "ENGINE_ERROR"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class TokenLimitExceeded(EngineError):
    code = "TOKEN_LIMIT_EXCEEDED"


class ValidationError(EngineError):
    code = "VALIDATION_ERROR"


class GatewayError(EngineError):
    code = "GATEWAY_ERROR"


class ConfigError(EngineError):
    code = "CONFIG_ERROR"


class CheckpointConflict(EngineError):
    code = "CHECKPOINT_CONFLICT"


class StoreConflict(EngineError):
    code = "STORE_CONFLICT"


class ResultApplicationError(EngineError):
    code = "RESULT_APPLICATION_ERROR"


class ReconciliationError(EngineError):
    code = "RECONCILIATION_ERROR"
