"""Error kinds, their inference from messages, and errors of browser back ends, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.schemas import ERROR, QUERY

# Kinds of errors.
KINDS = ("http", "dataset", "worker", "backend", "context", "io", "timeout", "other")
# Category of each browser error, the kind it maps to, and whether trying again may help.
BROWSER_ERRORS = {
    "connection_failed": ("connection", "http", True),
    "webdriver": ("webdriver", "backend", False),
    "invalid_session": ("session", "backend", False),
    "timeout": ("timeout", "timeout", True),
    "pool_exhausted": ("pool", "backend", True),
    "configuration": ("config", "backend", False),
    "process_error": ("process", "backend", False),
    "element_error": ("element", "worker", False),
    "navigation_error": ("navigation", "http", False),
    "javascript_error": ("script", "worker", False),
    "resource_error": ("resource", "io", True),
    "capability_error": ("capability", "backend", False),
    "operation_failed": ("operation", "backend", True),
}
# Texts of navigation errors; an HTTP error adds its status.
NAVIGATION = {
    "invalid_url": "Invalid URL",
    "network": "Network error",
    "http": "HTTP error",
    "certificate": "Certificate error",
    "timeout": "Navigation timeout",
    "blocked": "Navigation blocked",
    "unknown": "Unknown navigation error",
}


def _optional(before: str, value: Column | None, after: str = "") -> Column:
    return F.lit("") if value is None else F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))


def make_error(kind: str | Column, message: Column, source: Column | None = None, query: Column | None = None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    none = F.lit(None)
    return F.struct(kind.alias("kind"), message.alias("message"), (none if source is None else source).cast("string").alias("source"), (none if query is None else query).cast(QUERY).alias("query")).cast(ERROR)


def infer_kind(message: Column) -> Column:
    """Kind of an error that is only a message: by parts of it, in this order, case counting; null is ``other``."""
    has = lambda *parts: F.greatest(*[F.contains(message, F.lit(p)) for p in parts])
    return F.when(has("http", "request"), "http").when(has("io", "file"), "io").when(F.contains(message, F.lit("timeout")), "timeout").otherwise("other")


def from_message(message: Column) -> Column:
    return make_error(infer_kind(message), message, source=message)


def http_error() -> Column:
    return make_error("http", F.lit("HTTP error"))


def io_error() -> Column:
    return make_error("io", F.lit("I/O error"))


def display(error: Column) -> Column:
    return F.format_string("[%s] %s", error["kind"], error["message"])


def _lookup(name: Column, at: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in BROWSER_ERRORS.items() for x in (k, v[at])])[name]


def browser_category(name: Column) -> Column:
    return _lookup(name, 0)


def browser_kind(name: Column) -> Column:
    return _lookup(name, 1)


def browser_retryable(name: Column, navigation: Column | None = None, status: Column | None = None) -> Column:
    """Navigation errors only for the network, a timeout or a status from 500 to 599."""
    if navigation is None:
        return _lookup(name, 2)
    again = navigation.isin("network", "timeout") | ((navigation == "http") & F.coalesce(status.between(500, 599), F.lit(False)) if status is not None else F.lit(False))
    return F.when(name == "navigation_error", F.coalesce(again, F.lit(False))).otherwise(_lookup(name, 2))


def navigation_text(kind: Column, status: Column | None = None) -> Column:
    text = F.create_map(*[F.lit(x) for p in NAVIGATION.items() for x in p])[kind]
    return text if status is None else F.when(kind == "http", F.concat_ws(" ", text, status.cast("string"))).otherwise(text)


def browser_message(name: str, **a: Column) -> Column:
    """The text of a browser error from its parts; optional parts may be null or left out."""
    get = a.get
    text = F.concat
    lit = F.lit
    made = {
        "connection_failed": lambda: text(lit("Failed to connect to WebDriver server at '"), get("url"), lit("': "), get("source")),
        "webdriver": lambda: text(lit("WebDriver error"), _optional(" during ", get("context")), lit(": "), get("error")),
        "invalid_session": lambda: text(lit("Invalid browser session"), _optional(" '", get("session_id"), "'"), lit(": "), get("reason")),
        "timeout": lambda: text(lit("Operation '"), get("operation"), lit("' timed out after "), get("duration_secs").cast("string"), lit(" seconds")),
        "pool_exhausted": lambda: text(lit("Browser pool exhausted: "), get("active_connections").cast("string"), lit("/"), get("pool_size").cast("string"), lit(" connections active")),
        "configuration": lambda: text(lit("Configuration error"), _optional(" in '", get("field"), "'"), lit(": "), get("message")),
        "process_error": lambda: text(lit("Process '"), get("operation"), lit("' failed"), _optional(" with exit code ", get("exit_code")), lit(": "), get("message")),
        "element_error": lambda: text(lit("Element operation '"), get("operation"), lit("' failed"), _optional(" on selector '", get("selector"), "'"), lit(": "), get("reason")),
        "navigation_error": lambda: text(lit("Navigation to '"), F.coalesce(get("url"), lit("unknown")) if get("url") is not None else lit("unknown"), lit("' failed: "), get("error_type"), _optional(" (", get("details"), ")")),
        "javascript_error": lambda: text(lit("Script execution failed: "), get("message"), lit("\nScript: "), get("script")),
        "resource_error": lambda: text(lit("Resource error for "), get("resource_type"), lit(" '"), get("identifier"), lit("': "), get("reason")),
        "capability_error": lambda: text(lit("Capability '"), get("capability"), lit("' error with value '"), get("value"), lit("': "), get("reason")),
        "operation_failed": lambda: text(lit("Operation '"), get("operation"), lit("' failed: "), get("message")),
    }
    return made[name]()


def from_browser(name: str, **parts: Column) -> Column:
    return make_error(BROWSER_ERRORS[name][1], browser_message(name, **parts))
