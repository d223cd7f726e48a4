"""Errors of stores, transactions, codecs and subscriptions."""

from __future__ import annotations

from contextlib import contextmanager


class StoreError(Exception):
    """Anything that a store or one of its buckets refuses."""


class BucketExists(StoreError):
    pass


class BucketMissing(StoreError):
    pass


class KeyValueMissing(StoreError):
    pass


class IncompatibleValue(StoreError):
    """A bucket stands where a value was asked for, or the other way round."""


class ReadOnlyTx(StoreError):
    pass


class ReadOnlyStore(StoreError):
    pass


class WriterTimeout(StoreError):
    pass


class InvalidStore(StoreError):
    """The store's files contradict each other or its manifest."""


class CapacityExceeded(StoreError):
    pass


class MergeConflict(StoreError):
    def __init__(self, path: list[bytes]):
        super().__init__("merge conflict at " + "/".join(p.decode("utf-8", "replace") for p in path))
        self.path = path


class CodecError(StoreError):
    pass


class DecodeError(CodecError):
    pass


class OrderingRequired(CodecError):
    """The key codec doesn't keep order, so ranges have no meaning."""


class SchemaMissing(CodecError):
    pass


class SchemaMismatch(CodecError):
    pass


class InvalidDefinition(CodecError):
    pass


class WatchError(Exception):
    pass


class WatchEmpty(WatchError):
    pass


class WatchOverflow(WatchError):
    pass


class WatchDisconnected(WatchError):
    pass


class TransactionError(Exception):
    """A scoped transaction failed: ``storage`` holds the store's error, ``application`` the caller's."""

    def __init__(self, storage: StoreError | None = None, application: BaseException | None = None):
        super().__init__(str(storage or application))
        self.storage, self.application = storage, application


#: What Spark says of files that are gone, cut short or no Parquet.
_DAMAGE = ("FAILED_READ_FILE", "FileNotFoundException", "is not a Parquet file", "PATH_NOT_FOUND", "Could not read footer", "CANNOT_READ_FILE_FOOTER")


def unreadable(e: BaseException) -> bool:
    return any(x in str(e) for x in _DAMAGE)


@contextmanager
def typed_reads():
    """Turns Spark's errors about unreadable files into ``InvalidStore``."""
    try:
        yield
    except StoreError:
        raise
    except Exception as e:
        if unreadable(e):
            raise InvalidStore(f"a data file can't be read: {str(e).splitlines()[0][:200]}") from e
        raise
