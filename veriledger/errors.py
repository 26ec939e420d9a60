"""Typed errors. Every check of an input raises one of these, never a bare engine error."""


class VeriledgerError(Exception):
    """Base of all errors that this package raises on purpose."""


class RecordError(VeriledgerError, ValueError):
    """An account, transfer or device row breaks a rule of its own."""


class LedgerError(VeriledgerError):
    """Rows are valid but do not form a ledger."""


class SignalError(VeriledgerError):
    """Signals cannot be computed: bad window, bad depth or an unknown account."""


class ThresholdError(VeriledgerError, ValueError):
    """A threshold is out of its range."""


class CorpusError(VeriledgerError):
    """Provision files are missing, empty or malformed."""


class IndexError_(VeriledgerError):
    """The provision index cannot be built or asked."""


class RetrievalError(VeriledgerError, ValueError):
    """Grounding was asked for an account that is not flagged."""


class AuditError(VeriledgerError):
    """The audit chain is malformed or was changed."""


class GroundingEvaluationError(VeriledgerError):
    """There is nothing whose grounding could be evaluated."""


class TopologyEvaluationError(VeriledgerError):
    """There is nothing to evaluate, or it names accounts that the ledger lacks."""
