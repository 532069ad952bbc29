"""Error types with their codes; the exit codes of the command line are in ``cli``."""


class ChatlakeError(Exception):
    """Base of all errors; ``code`` names the class of failure."""

    code = "LP2000"

    def __init__(self, message: str, *, code: str | None = None):
        super().__init__(message)
        self.code = code or self.code

    def payload(self) -> dict:
        """The error as a record for a machine to read."""
        return {"code": self.code, "type": type(self).__name__, "message": str(self)}


class InputError(ChatlakeError):
    """The input cannot be read."""

    code = "LP2100"


class AdapterError(ChatlakeError):
    """A provider's normaliser failed or is unknown."""

    code = "LP2200"


class WriteError(ChatlakeError):
    """An output cannot be written."""

    code = "LP2300"


class ValidationError(ChatlakeError):
    """A record or file does not fit its schema."""

    code = "LP2000"
