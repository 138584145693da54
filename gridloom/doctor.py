"""What this installation can do, as one JSON report."""

from __future__ import annotations

import importlib.util
import json
import logging
import logging.handlers
import platform
import shutil
from pathlib import Path

from gridloom import __version__
from gridloom.sources.ocr import locate_command

REQUIRED = ("pyspark", "pyarrow", "pandas", "numpy")
OPTIONAL = ("fitz", "pdfplumber", "cv2", "pytesseract", "openpyxl")


def report() -> dict:
    found = {m: importlib.util.find_spec(m) is not None for m in (*REQUIRED, *OPTIONAL)}
    return {
        "version": __version__, "python": platform.python_version(), "java": shutil.which("java") is not None,
        "modules": found, "ocr_command": str(locate_command() or ""), "ok": all(found[m] for m in REQUIRED),
    }


def self_test(output: Path | None = None) -> int:
    """Writes the report, to a file if one is named; 0 if everything required is there."""
    facts = report()
    text = json.dumps(facts, indent=2)
    if output:
        output.parent.mkdir(parents=True, exist_ok=True)
        output.write_text(text, "utf-8")
    else:
        print(text)
    return 0 if facts["ok"] else 1


def log_to(path: Path, level: int = logging.INFO) -> logging.Logger:
    """The package's log in a file that turns over at 1 MB and keeps three."""
    path.parent.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("gridloom")
    if not any(isinstance(h, logging.handlers.RotatingFileHandler) for h in log.handlers):
        handler = logging.handlers.RotatingFileHandler(path, maxBytes=1_000_000, backupCount=3, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log
