"""Errors that a query can raise before any Spark job runs."""


class MError(Exception):
    code = "M_ERROR"


class ParseError(MError):
    code = "M_PARSE_ERROR"

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class EvalError(MError):
    """The query is wrong: try ... otherwise catches it."""

    code = "M_EVAL_ERROR"


class UnsupportedError(MError):
    """The engine refuses rather than approximates: nothing catches it."""

    code = "M_EVAL_UNSUPPORTED"
