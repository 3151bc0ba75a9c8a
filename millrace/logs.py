"""Logging set-up: level, where to, layout, daily files."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass
from logging.handlers import TimedRotatingFileHandler

FORMATS = {"pretty": "%(asctime)s %(levelname)-7s %(name)s: %(message)s", "compact": "%(levelname).1s %(name)s %(message)s"}


@dataclass(frozen=True)
class LogConfig:
    level: str = "INFO"
    output: str = "stdout"  # stdout, file or both
    layout: str = "pretty"
    directory: str = "logs"
    days: int = 7


def configure(config: LogConfig = LogConfig()) -> logging.Logger:
    """Sets up the package's logger; MILLRACE_LOG in the environment overrides the level."""
    logger = logging.getLogger("millrace")
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    logger.setLevel(os.environ.get("MILLRACE_LOG", config.level).upper())
    handlers: list[logging.Handler] = []
    if config.output in ("stdout", "both"):
        handlers.append(logging.StreamHandler(sys.stdout))
    if config.output in ("file", "both"):
        os.makedirs(config.directory, exist_ok=True)
        handlers.append(TimedRotatingFileHandler(os.path.join(config.directory, "millrace.log"), when="midnight", backupCount=config.days))
    for handler in handlers:
        handler.setFormatter(logging.Formatter(FORMATS[config.layout]))
        logger.addHandler(handler)
    return logger
