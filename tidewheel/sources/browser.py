"""Settings of browser back ends, checked when they are made, and pages that come from a table (``pool`` drives browsers)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.extract import browser_content
from tidewheel.functions.select import view
from tidewheel.sources.backends import TableBackend


class ConfigError(ValueError):
    """A setting that cannot be; ``kind`` is always ``backend``."""

    kind = "backend"


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class BrowserConfig:
    """Where a browser is reached. Time limits are checked, and not used without a browser."""

    url: str = "http://127.0.0.1:4444"
    connect_timeout_s: float = 30
    request_timeout_s: float = 60
    is_managed: bool = False
    capabilities: dict[str, str] = field(default_factory=dict)

    def validate(self) -> BrowserConfig:
        _need(bool(self.url), "WebDriver URL cannot be empty")
        _need(self.url.startswith(("http://", "https://")), f"Invalid WebDriver URL format: {self.url}")
        _need(self.connect_timeout_s > 0, "Connect timeout must be greater than zero")
        _need(self.request_timeout_s > 0, "Request timeout must be greater than zero")
        return self

    def base_url(self) -> str:
        return self.url.rstrip("/")

    def with_capability(self, name: str, value: str) -> BrowserConfig:
        return replace(self, capabilities={**self.capabilities, name: value})

    def with_capabilities(self, values: dict[str, str]) -> BrowserConfig:
        return replace(self, capabilities={**self.capabilities, **values})

    def with_connect_timeout(self, seconds: float) -> BrowserConfig:
        return replace(self, connect_timeout_s=seconds)

    def managed(self) -> BrowserConfig:
        return replace(self, is_managed=True)

    def unmanaged(self) -> BrowserConfig:
        return replace(self, is_managed=False)

    def __str__(self) -> str:
        return f"Browser({self.url}, managed: {str(self.is_managed).lower()})"


@dataclass(frozen=True)
class BehaviorConfig:
    """What is taken from a page, and how much of it."""

    navigation_timeout_s: int = 30
    element_timeout_s: int = 10
    extract_html: bool = True
    extract_text: bool = False
    enable_javascript: bool = True
    wait_for_load: bool = True
    user_agent: str | None = None
    max_response_size: int = 10 * 1024 * 1024
    capture_screenshots: bool = False

    def __post_init__(self) -> None:
        _need(self.navigation_timeout_s >= 1, "Navigation timeout must be greater than 0")
        _need(self.element_timeout_s >= 1, "Element timeout must be greater than 0")
        _need(self.max_response_size > 0, "Max response size must be greater than 0")
        _need(self.user_agent is None or bool(self.user_agent.strip()), "User agent cannot be empty")


@dataclass(frozen=True)
class PoolConfig:
    """Endpoints, size and upkeep of a pool of connections."""

    configs: tuple[BrowserConfig, ...] = ()
    max_size: int = 10
    min_size: int = 1
    acquire_timeout_s: float | None = None
    max_lifetime_s: float | None = None
    max_idle_s: float | None = None
    health_checks: bool = True
    max_retry_attempts: int = 3
    checked: bool = True

    def with_unmanaged(self, url: str) -> PoolConfig:
        return replace(self, configs=(*self.configs, BrowserConfig(url)))

    def with_managed(self, url: str) -> PoolConfig:
        return replace(self, configs=(*self.configs, BrowserConfig(url, is_managed=True)))

    def with_config(self, config: BrowserConfig) -> PoolConfig:
        return replace(self, configs=(*self.configs, config.validate() if self.checked else config))

    def with_configs(self, configs) -> PoolConfig:
        out = self
        for c in configs:
            out = out.with_config(c)
        return out

    def with_max_retry_attempts(self, n: int) -> PoolConfig:
        return replace(self, max_retry_attempts=max(1, n))

    def with_sizes(self, max_size: int | None = None, min_size: int | None = None) -> PoolConfig:
        return replace(self, max_size=self.max_size if max_size is None else max_size, min_size=self.min_size if min_size is None else min_size)

    def with_times(self, acquire_s: float | None = None, lifetime_s: float | None = None, idle_s: float | None = None) -> PoolConfig:
        """How long to wait for a connection, and the age and idle time at which one is replaced; None for no limit."""
        return replace(self, acquire_timeout_s=acquire_s, max_lifetime_s=lifetime_s, max_idle_s=idle_s)

    def with_health_checks(self, on: bool) -> PoolConfig:
        return replace(self, health_checks=on)

    def without_config_validation(self) -> PoolConfig:
        """Configurations added from here on are not checked."""
        return replace(self, checked=False)

    def validate(self) -> PoolConfig:
        _need(bool(self.configs), "At least one WebDriver configuration is required")
        _need(self.max_size > 0, "Pool max_size must be greater than zero")
        _need(self.min_size <= self.max_size, "Pool min_size cannot be greater than max_size")
        return self

    def build(self, pages: DataFrame, behavior: BehaviorConfig | None = None) -> BrowserBackend:
        return BrowserBackend(pages, self.validate(), behavior or BehaviorConfig())

    def drive(self, make, fetch, behavior: BehaviorConfig | None = None, **options):
        """A back end that drives browsers: see ``pool.DriverBackend``. Without an endpoint there is the default one."""
        from tidewheel.sources.pool import DriverBackend

        own = self if self.configs else replace(self, configs=(BrowserConfig(),))
        return DriverBackend(own.validate(), make, fetch, behavior=behavior or BehaviorConfig(), **options)

    def select(self, seq: int) -> BrowserConfig:
        return self.configs[seq % len(self.configs)]


@dataclass(frozen=True)
class BrowserBackend:
    """Rendered pages (``uri, html``) by lookup. A page is status 200 and HTML; a miss is a navigation error."""

    pages: DataFrame
    pool: PoolConfig
    behavior: BehaviorConfig

    def __call__(self, requests: DataFrame) -> DataFrame:
        b = self.behavior
        kind = F.create_map(F.lit("content-type"), F.array(F.lit("text/html; charset=utf-8")))
        stored = self.pages.select("uri", F.col("html").cast("binary").alias("body"), kind.alias("headers"))
        got = TableBackend(stored, miss_status=0)(requests)
        missed = F.col("status") == 0
        html = F.col("response_body").cast("string")
        # pages are parsed once they are joined: only those that were asked for
        inner = view(html, F.col("uri"))["text"] if b.extract_text and not b.extract_html else F.lit(None).cast("string")
        why = F.concat(F.lit("Navigation to '"), F.col("uri"), F.lit("' failed: Network error"))
        return got.withColumns({
            "connect_error": F.when(missed, why), "status": F.when(~missed, F.col("status")), "response_body": browser_content(html, inner, b.extract_html, b.extract_text, b.max_response_size).cast("binary"),
        })
