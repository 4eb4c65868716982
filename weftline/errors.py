"""Errors of the engine: one exception type with a code."""

from __future__ import annotations

from enum import Enum


class ErrorCode(Enum):
    NONE = "none"
    NAME_RESOLUTION = "name resolution"
    ELEMENT_CREATION = "element creation"
    ELEMENT_UPDATE = "element update"
    ELEMENT_DELETE = "element delete"
    DEFINITION = "definition"
    EVALUATION = "evaluation"
    SERVER = "server"
    CONNECTOR = "connector"
    ACTION = "action"
    GENERAL = "general"


class EngineError(Exception):
    """Raised at definition time; evaluation errors are also kept on the element."""

    def __init__(self, code: ErrorCode, message: str, description: str = ""):
        super().__init__(f"{code.value}: {message}" + (f" ({description})" if description else ""))
        self.code, self.message, self.description = code, message, description
