"""Predicates over paths, commands and search results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What no path may hold, what makes a command critical (both whatever the case), what no result's address may hold.
PATHS = [r"\.\.", r"/etc", r"/usr", r"/bin", r"/sbin", r"C:\\Windows", r"System32"]
COMMANDS = [r"\brm\s+-rf\b", r"\bdel\s+/[sf]\b", r"\bformat\b", r"\bmkfs\b", r"\bdd\s+if=", r">\s*/dev/", r"\bshutdown\b", r"\breboot\b", r"\bchmod\s+777\b"]
HOSTS = ["pinterest.", "facebook.com", "twitter.com", "x.com", "instagram.", "tiktok."]
LEAST_TITLE = 5


def is_safe_path(path: Column, root: str) -> Column:
    """No forbidden part, and relative or below the root. With '..' forbidden a relative path cannot leave it."""
    below = (path == root) | path.startswith(root.rstrip("/") + "/")
    absolute = path.startswith("/") | path.rlike(r"^[A-Za-z]:")
    return ~path.rlike("(?i)" + "|".join(PATHS)) & (~absolute | below)


def is_critical(command: Column) -> Column:
    return command.rlike("(?i)" + "|".join(COMMANDS))


def is_usable_result(url: Column, title: Column) -> Column:
    return ~F.exists(F.array(*map(F.lit, HOSTS)), lambda b: F.lower(url).contains(b)) & (F.length(title) >= LEAST_TITLE)
