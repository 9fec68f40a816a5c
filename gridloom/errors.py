"""Errors and warnings with numeric codes, and the one user hook: an error handler."""

from __future__ import annotations

import logging
import time
import warnings

log = logging.getLogger("gridloom")


class GridloomError(Exception):
    code = 1

    def __init__(self, message: str = "", code: int | None = None):
        super().__init__(message or (self.__doc__ or "").strip())
        self.code = type(self).code if code is None else code


class ArgumentError(GridloomError, ValueError):
    """invalid argument"""

    code = 2


class DimensionError(ArgumentError):
    """dimensions don't agree"""

    code = 3


class BoundsError(ArgumentError, IndexError):
    """index out of bounds"""

    code = 4


class EntryNotFound(GridloomError, KeyError):
    """no such entry in the matrix"""

    code = 5


class FormatError(GridloomError):
    """malformed matrix file"""

    code = 6


class NotReordered(GridloomError):
    """the matrix has no permutation"""

    code = 7


class OptionError(ArgumentError):
    """unknown option or value"""

    code = 8


class GridloomWarning(UserWarning):
    pass


def _default(error: GridloomError) -> None:
    raise error


_handler = [_default]


def set_error_handler(handler=None) -> None:
    """Handler called with each error raised through ``fail``; None restores the default, raising."""
    _handler[0] = handler or _default


def get_error_handler():
    return _handler[0]


def fail(error: GridloomError):
    return _handler[0](error)


def warn(message: str) -> None:
    warnings.warn(message, GridloomWarning, stacklevel=2)


def log_to_console(level: int = logging.INFO) -> None:
    _log_to(logging.StreamHandler(), level)


def log_to_file(path: str, level: int = logging.INFO) -> None:
    _log_to(logging.FileHandler(path), level)


def _log_to(handler: logging.Handler, level: int) -> None:
    handler.setLevel(level)
    log.addHandler(handler)
    log.setLevel(min(level, log.level or level))


def log_off() -> None:
    log.handlers.clear()


class Timer:
    """Adds up wall-clock seconds between ``start`` and ``pause``."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._total, self._since = 0.0, None

    def start(self) -> None:
        self._since = time.perf_counter()

    def pause(self) -> None:
        if self._since is not None:
            self._total += time.perf_counter() - self._since
            self._since = None

    @property
    def seconds(self) -> float:
        return self._total + (time.perf_counter() - self._since if self._since is not None else 0.0)


def mflops(nnz: int, loops: int, seconds: float) -> float:
    """Two operations per non-zero and multiplication."""
    return 2 * loops * nnz / (1e6 * seconds)
