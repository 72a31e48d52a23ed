"""Configuration: rules, naming convention, defaults, loading, merging, saving.

A JSON or YAML null for a rule's target folder means "none".  An empty YAML file overrides
nothing.  The level of a configuration file holds unless the caller passes another.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

KEBAB, SNAKE, CAMEL, PASCAL = "kebab-case", "snake_case", "camelCase", "PascalCase"
CONVENTIONS = (KEBAB, SNAKE, CAMEL, PASCAL)
FORMATS = ("json", "yaml", "yml")
#: Looked for in this order.
CONFIG_FILES = (".shelfmark.yml", ".shelfmark.yaml", "shelfmark.config.json")


@dataclass(frozen=True)
class Rule:
    """Files of one category; with patterns, one of them has to match as well."""

    name: str
    extensions: tuple[str, ...]
    patterns: tuple[str, ...] | None = None
    target_folder: str | None = None


@dataclass(frozen=True)
class NamingConvention:
    type: str = KEBAB
    lowercase: bool = True


# The default rules, in their order.
DEFAULT_RULES = (
    Rule("images", (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico"), None, "images"),
    Rule("documents", (".pdf", ".doc", ".docx", ".txt", ".md", ".odt", ".rtf"), None, "documents"),
    Rule("videos", (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm"), None, "videos"),
    Rule("audio", (".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a"), None, "audio"),
    Rule("archives", (".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz"), None, "archives"),
    Rule("code", (".js", ".ts", ".py", ".java", ".cpp", ".c", ".h", ".cs", ".go", ".rs", ".php", ".rb"), None, "code"),
    Rule("spreadsheets", (".xlsx", ".xls", ".csv", ".ods"), None, "spreadsheets"),
    Rule("presentations", (".ppt", ".pptx", ".odp", ".key"), None, "presentations"),
)
# What is excluded by default.
DEFAULT_EXCLUDES = ("node_modules/**", ".git/**", "dist/**", "build/**", ".DS_Store")


@dataclass(frozen=True)
class Config:
    categories: tuple[Rule, ...] = DEFAULT_RULES
    naming_convention: NamingConvention = field(default_factory=NamingConvention)
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDES
    include_hidden: bool = False
    dry_run: bool = False
    generate_manifest: bool = True
    log_level: str = "info"
    log_file: str | None = None
    target_directory: str | None = None


# Names in configuration files.
KEYS = {
    "includeHidden": "include_hidden", "dryRun": "dry_run", "generateManifest": "generate_manifest",
    "logLevel": "log_level", "logFile": "log_file", "targetDirectory": "target_directory",
}


def _rule(raw: dict[str, Any]) -> Rule:
    patterns = raw.get("patterns")
    return Rule(raw["name"], tuple(raw.get("extensions") or ()), None if patterns is None else tuple(patterns), raw.get("targetFolder"))


def merge(base: Config, override: dict[str, Any] | None) -> Config:
    """Shallow: lists replace lists, the naming convention merges one level down."""
    override = override or {}
    out = {ours: override[theirs] for theirs, ours in KEYS.items() if theirs in override}
    if override.get("categories") is not None:
        out["categories"] = tuple(map(_rule, override["categories"]))
    if override.get("excludePatterns") is not None:
        out["exclude_patterns"] = tuple(override["excludePatterns"])
    if naming := override.get("namingConvention"):
        out["naming_convention"] = replace(base.naming_convention, **{k: naming[k] for k in ("type", "lowercase") if k in naming})
    return replace(base, **out)


def as_dict(config: Config) -> dict[str, Any]:
    rules = [
        {"name": r.name, "extensions": list(r.extensions)}
        | ({} if r.patterns is None else {"patterns": list(r.patterns)})
        | ({} if r.target_folder is None else {"targetFolder": r.target_folder})
        for r in config.categories
    ]
    out: dict[str, Any] = {
        "categories": rules,
        "namingConvention": {"type": config.naming_convention.type, "lowercase": config.naming_convention.lowercase},
        "excludePatterns": list(config.exclude_patterns),
    }
    return out | {theirs: v for theirs, ours in KEYS.items() if (v := getattr(config, ours)) is not None}


def _yaml():
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML configuration needs PyYAML; use JSON") from error
    return yaml


def parse(path: str) -> dict[str, Any] | None:
    """Read a configuration file by its lower-cased extension."""
    ext = os.path.splitext(path)[1].lower()
    with open(path, encoding="utf-8") as f:
        content = f.read()
    if ext == ".json":
        return json.loads(content)
    if ext in (".yml", ".yaml"):
        return _yaml().safe_load(content)
    raise ValueError(f"Unsupported config file format: {ext}")


def stringify(config: Config, kind: str) -> str:
    if kind == "json":
        return json.dumps(as_dict(config), indent=2, ensure_ascii=False)
    if kind == "yaml":
        return _yaml().safe_dump(as_dict(config), sort_keys=False, allow_unicode=True)
    raise ValueError(f"Unsupported format: {kind}")


def find(folder: str = ".", names: tuple[str, ...] = CONFIG_FILES) -> str | None:
    """The first configuration file that exists."""
    return next((p for n in names if os.path.exists(p := os.path.join(os.path.abspath(folder), n))), None)


def load(path: str | None = None, folder: str = ".", names: tuple[str, ...] = CONFIG_FILES) -> Config:
    """Defaults, overridden by the file given (which has to exist) or found."""
    if path and not os.path.exists(path):
        raise FileNotFoundError(f"Config file not found: {path}")
    path = path or find(folder, names)
    return merge(Config(), parse(path)) if path else Config()


def with_overrides(config: Config, dry_run: bool | None = None, manifest: bool | None = None, log_level: str | None = None,
                   output: str | None = None) -> Config:
    """What a caller sets wins over the file; the output folder becomes absolute."""
    out = {"dry_run": dry_run or None, "generate_manifest": False if manifest is False else None, "log_level": log_level,
           "target_directory": os.path.abspath(output) if output else None}
    return replace(config, **{k: v for k, v in out.items() if v is not None})


def save(config: Config, path: str) -> None:
    kind = "json" if os.path.splitext(path)[1].lower() == ".json" else "yaml"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(stringify(config, kind))


def validate_format(kind: str) -> str:
    if kind.lower() not in FORMATS:
        raise ValueError("Invalid format. Use json or yaml.")
    return kind.lower()


def config_filename(kind: str) -> str:
    return CONFIG_FILES[2] if kind == "json" else CONFIG_FILES[0]
