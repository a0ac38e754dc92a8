"""Scan settings."""

from __future__ import annotations

from dataclasses import dataclass

from codewarden.catalog.policy import DEFAULT_ACTIVE

# Defaults of the settings and of the file discovery.
MANDATORY_EXCLUDES = ("node_modules", ".git", "coverage", "lcov-report", "build", "dist", "out", ".next")
DEFAULT_EXCLUDES = ("node_modules", "dist", "out", ".git", "coverage", "lcov-report", "build", ".next",
                    "*.min.js", "*.min.css")


@dataclass(frozen=True)
class ScanConfig:
    """What a scan looks at and how it scores.

    ``active_policies=None`` means every policy rule, an empty tuple means none;
    ``max_file_size_kb=None`` means files of any size.
    """

    detection_threshold: float = 0.65
    heuristic_weight: float = 0.4
    ai_weight: float = 0.6
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDES
    max_file_size_kb: int | None = None
    active_policies: tuple[str, ...] | None = DEFAULT_ACTIVE
    max_tokens: int = 4096
    temperature: float = 0.1
    preferred_provider: str = "auto"
