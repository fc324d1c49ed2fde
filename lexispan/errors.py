"""One exception class with a stable kind; failures of data are rows of an errors table instead."""

from __future__ import annotations

#: Kinds of failures as they appear in error payloads.
KINDS = (
    "Io", "Graph", "Parse", "SymbolNotFound", "AmbiguousSymbol", "ReferenceFailed", "AmbiguousReference", "InvalidSpan",
    "CompilerError", "ParseValidationFailed", "CargoCheckFailed", "CompilerValidationFailed", "AnalyzerNotAvailable",
    "AnalyzerFailed", "InvalidPlanSchema", "InvalidBatchSchema", "PlanExecutionFailed", "Utf8", "Other",
)


class SpanError(Exception):
    """``kind`` is one of KINDS; symbol, file, hint and diagnostics are context for payloads."""

    def __init__(self, kind: str, message: str, *, symbol: str | None = None, file: str | None = None, hint: str | None = None, diagnostics: list[dict] | None = None):
        assert kind in KINDS
        super().__init__(message)
        self.kind, self.symbol, self.file, self.hint, self.diagnostics = kind, symbol, file, hint, diagnostics or []

    def payload(self) -> dict:
        detail = {"kind": self.kind, "message": str(self), "symbol": self.symbol, "file": self.file, "hint": self.hint, "diagnostics": self.diagnostics or None}
        return {"status": "error", "error": {k: v for k, v in detail.items() if v is not None}}


def not_found(name: str, file: str | None = None, kind: str | None = None) -> SpanError:
    where = f" in {file}" if file else ""
    what = f" of kind {kind}" if kind else ""
    return SpanError("SymbolNotFound", f"Symbol '{name}'{what} not found{where}", symbol=name, file=file, hint="Check the spelling, or list the file's symbols first")
