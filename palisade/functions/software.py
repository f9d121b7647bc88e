"""Installed-software tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ports whose presence marks a host as a server.
SERVER_PORTS = (22, 23, 25, 53, 80, 110, 143, 443, 445, 465, 587, 993, 995, 1433, 1521, 3306, 3389,
                5432, 5900, 6379, 8080, 8443, 27017)

# Outdated-version patterns, keyed by the word the product must contain.
OUTDATED_PATTERNS = {
    "openssh": r"OpenSSH[_\s]([0-7]\.[0-9])",
    "apache": r"Apache/([12]\.[0-4])",
    "nginx": r"nginx/([01]\.[0-9]|1\.[0-1][0-7])",
    "mysql": r"MySQL.*([0-4]\.|5\.[0-6])",
    "postgresql": r"PostgreSQL.*([0-9]\.|1[0-2]\.)",
}
# First (major, minor) release that is no longer called outdated, for numeric mode.
NUMERIC_FLOORS = {
    "openssh": (8, 0), "apache": (2, 5), "nginx": (1, 18), "mysql": (5, 7), "postgresql": (13, 0),
}


def has_server_port(open_ports: Column) -> Column:
    known = F.array(*[F.lit(p) for p in SERVER_PORTS])
    return F.coalesce(F.arrays_overlap(open_ports, known), F.lit(False))


def is_outdated(product: Column, version: Column, mode: str = "legacy") -> Column:
    """``legacy`` applies the patterns to "product version"; ``numeric`` compares releases."""
    name = F.lower(product)
    present = (F.length(name) > 0) & (F.length(version) > 0)
    hit = F.lit(False)
    if mode == "legacy":
        line = F.concat_ws(" ", name, version)
        for word, pattern in OUTDATED_PATTERNS.items():
            hit = hit | (name.contains(word) & line.rlike(f"(?id){pattern}"))
    elif mode == "numeric":
        found = r"(\d+)(?:\.(\d+))?"
        major = F.regexp_extract(version, found, 1).try_cast("int")
        minor = F.coalesce(F.regexp_extract(version, found, 2).try_cast("int"), F.lit(0))
        for word, (floor_major, floor_minor) in NUMERIC_FLOORS.items():
            older = (major < floor_major) | ((major == floor_major) & (minor < floor_minor))
            hit = hit | (name.contains(word) & older)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(present & hit, F.lit(False))
