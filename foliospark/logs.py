"""Logging of the driver: rotating files in a folder that can be written, secrets masked in every handler."""

from __future__ import annotations

import logging
import tempfile
from collections.abc import Iterable
from logging.handlers import RotatingFileHandler
from pathlib import Path

from foliospark.functions.security import MaskingFilter

FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def writable_folder(candidates: Iterable[str | Path], name: str = "logs", default: str | Path | None = None) -> Path:
    """The first candidate in which a folder ``name`` can be made and written; the default if there is none, else an error."""
    for base in candidates:
        folder = Path(base) / name
        try:
            folder.mkdir(parents=True, exist_ok=True)
            with tempfile.TemporaryFile(dir=folder):
                return folder
        except OSError:
            continue
    if default is None:
        raise RuntimeError(f"no folder for {name} can be written")
    return Path(default)


def set_up_logging(
    logger: logging.Logger, folder: str | Path | None = None, file: str | None = "application.log", level: int = logging.DEBUG, *,
    propagate: bool = True, max_bytes: int = 1 << 20, backups: int = 5, mask: logging.Filter | None = None,
) -> logging.Logger:
    """Console and, with a file name, a rotating file; called again, it replaces the handlers of before and closes them.

    Without a folder the file goes to ``logs`` below the home or the working folder. Only the driver logs: tasks report through rows.
    """
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        target = Path(folder) if folder is not None else writable_folder([Path.home() / ".foliospark", Path.cwd()])
        target.mkdir(parents=True, exist_ok=True)
        handlers.append(RotatingFileHandler(target / file, maxBytes=max_bytes, backupCount=backups, encoding="utf-8"))
    for old in logger.handlers[:]:
        logger.removeHandler(old)
        old.close()
    for handler in handlers:
        handler.setFormatter(logging.Formatter(FORMAT))
        handler.addFilter(mask or MaskingFilter())
        logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = propagate
    return logger
