"""Failures of the ledger engine, by how a batch goes on after them."""


class LedgerError(ValueError):
    """The batch can't be delivered."""


class PlanRevision(LedgerError):
    """The plan has to be changed; evidence says where."""

    def __init__(self, message: str, evidence: dict | None = None):
        super().__init__(message)
        self.evidence = evidence or {}


class UnreadableSource(LedgerError):
    """One workbook can't be read; the others go on."""
