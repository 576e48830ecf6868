"""What a request can be refused with."""

from __future__ import annotations


class PalimpsestError(Exception):
    """Base of all errors of the store."""


class Closed(PalimpsestError):
    """The store was closed."""


class ReadOnly(PalimpsestError):
    """The store was opened for reading, or doesn't exist and may not be made."""


class UnknownBucket(PalimpsestError):
    """The bucket isn't registered."""


class BucketConflict(PalimpsestError):
    """The id belongs to another name."""


class BucketNameConflict(PalimpsestError):
    """The name belongs to another id."""


class InvalidRange(PalimpsestError):
    """The end is before the start, or bounds outside what there is."""


class UnknownMetric(PalimpsestError):
    """The gate doesn't grade this metric."""


class EmptyKey(PalimpsestError):
    """Keys have at least one byte."""


class EmptyValue(PalimpsestError):
    """Stored values have at least one byte."""


class NonEmpty(PalimpsestError):
    """The store was asked to be empty and isn't."""


class CommitConflict(PalimpsestError):
    """Another writer published first, too often in a row."""


class Compacted(PalimpsestError):
    def __init__(self, requested: int, floor: int):
        super().__init__(f"revision {requested} is below the compaction floor {floor}")
        self.requested, self.floor = requested, floor


class FutureRevision(PalimpsestError):
    def __init__(self, requested: int, current: int):
        super().__init__(f"revision {requested} is after the current revision {current}")
        self.requested, self.current = requested, current
