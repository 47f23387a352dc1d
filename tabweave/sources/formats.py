"""Supported formats, their extensions, and detection from a path."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    read: bool
    write: bool
    needs: str | None = None
    needs_written: str | None = None  # where writing needs another library than reading

    def needs_to(self, do: str) -> str | None:
        return self.needs_written if do == "write" and self.needs_written else self.needs


# Format names and file extensions.
FORMATS = (
    Format("csv", ("csv",), True, True),
    Format("tsv", ("tsv", "tab"), True, True),
    Format("json", ("json",), True, True),
    Format("ndjson", ("ndjson", "jsonl"), True, True),
    Format("parquet", ("parquet", "pq"), True, True),
    Format("feather", ("feather", "arrow", "ipc"), True, True),
    Format("hdf5", ("h5", "hdf5", "hdf"), True, True, "h5py"),
    Format("excel", ("xlsx", "xls"), True, True, "openpyxl"),
    Format("spss", ("sav", "zsav", "por"), True, True, "pyreadstat"),
    Format("stata", ("dta",), True, True),
    Format("sas", ("sas7bdat",), True, False),
    Format("xpt", ("xpt",), True, True, None, "pyreadstat"),
    Format("rds", ("rds",), False, False, "an R session"),
    Format("rdata", ("rda", "rdata"), False, False, "an R session"),
    Format("fst", ("fst",), False, False, "an R session"),
)
BY_NAME = {f.name: f for f in FORMATS}
BY_EXTENSION = {e: f for f in FORMATS for e in f.extensions}
CANONICAL = {"rdata": "rda", "feather": "feather", "hdf5": "h5", "excel": "xlsx", "spss": "sav", "stata": "dta"}
COMPRESSIONS = {"gz": "gzip", "bz2": "bzip2", "xz": "xz"}


def available(f: Format, do: str = "read") -> bool:
    needs = f.needs_to(do)
    return needs is None or (" " not in needs and importlib.util.find_spec(needs) is not None)


def supported_formats(available_only: bool = False) -> list[dict]:
    return [{"format": f.name, "extensions": ", ".join(f.extensions), "read": f.read, "write": f.write, "available": available(f)} for f in FORMATS if available(f) or not available_only]


def canonical_extension(name: str) -> str:
    return CANONICAL.get(name, name)


def detect(path: str, name: str | None = None) -> tuple[Format, str | None]:
    """Format and compression of a path; an explicit name or extension wins.  Only text formats may be compressed."""
    base = path.rstrip("/").rsplit("/", 1)[-1].lower()
    parts = base.split(".")
    packed = COMPRESSIONS.get(parts[-1]) if len(parts) > 1 else None
    if packed:
        parts = parts[:-1]
    if name:
        f = BY_NAME.get(name.lower()) or BY_EXTENSION.get(name.lower().lstrip("."))
        if f is None:
            raise ValueError(f"unknown format {name!r}")
    else:
        f = BY_EXTENSION.get(parts[-1]) if len(parts) > 1 else None
        if f is None:
            raise ValueError(f"cannot tell the format of {path!r}; pass format=")
    if packed and f.name not in ("csv", "tsv", "json", "ndjson"):
        raise ValueError(f"{f.name} files cannot be {packed}-compressed")
    return f, packed
