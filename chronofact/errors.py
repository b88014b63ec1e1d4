"""Errors of the engine, one class for each kind."""


class EngineError(Exception):
    """Base of all errors of this library."""


class TooLarge(EngineError):
    def __init__(self, what, length, most):
        super().__init__(f"{what}: {length}, at most {most}")
        self.what, self.len, self.max = what, length, most


class DimMismatch(EngineError):
    def __init__(self, got, want):
        super().__init__(f"vector of {got} components, expected {want}")
        self.got, self.want = got, want


class VectorSpaceMismatch(EngineError):
    def __init__(self, stored, requested):
        super().__init__(f"vectors of space {stored!r} are stored, {requested!r} was asked for")
        self.stored, self.requested = stored, requested


class CapacityExceeded(EngineError): ...


class NotFound(EngineError): ...


class AlreadyClosed(EngineError): ...


class StaleCursor(EngineError): ...


class UntrackedVectorSpace(EngineError): ...


class ConfigMismatch(EngineError): ...


class Corrupt(EngineError): ...


class Invalid(EngineError): ...


class StorageError(EngineError): ...


class Locked(EngineError): ...


class NeedsCheckpoint(EngineError): ...


class EmbedError(EngineError): ...


class ReembedBusy(EngineError): ...


class BadName(EngineError): ...


class NoSuchDatabase(EngineError): ...


class Busy(EngineError): ...


class AtCapacity(EngineError): ...


class InUse(EngineError): ...
