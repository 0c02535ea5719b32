"""Job and query options."""

from __future__ import annotations

from dataclasses import dataclass, field

# Folders that are never scanned, and the default ignore patterns.
IGNORED_DIRS = (".venv", "venv", "__pycache__", ".git", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".uv-cache", ".gemini", ".worktrees")
IGNORE_PATTERNS = ("**/__pycache__/**", "**/.git/**", "**/venv/**", "**/.venv/**")


@dataclass(frozen=True)
class IndexOptions:
    ignore_patterns: tuple[str, ...] = IGNORE_PATTERNS
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    max_file_size_mb: float = 5.0
    incremental: bool = False
    settle_s: float = 0.0  # files changed less than this ago wait for the next refresh


@dataclass(frozen=True)
class QueryOptions:
    max_results: int = 10
    graph_hops: int = 2
    mode: str = "full"
    include_code: bool = True
    corrected_scores: bool = False


@dataclass
class IndexResult:
    version: int
    files: int
    skipped: int
    symbols: int
    classes: int
    functions: int
    imports: int
    calls: int
    resolved_calls: int
    unresolved_calls: int
    elapsed_s: float
    errors: list[str] = field(default_factory=list)
