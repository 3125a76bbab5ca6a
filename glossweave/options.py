"""Run options and their merge with a configuration file."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, replace

from . import fixed
from .functions.locales import KNOWN_SHAPE


@dataclass(frozen=True)
class RunOptions:
    project: str
    languages: tuple[str, ...] = ()
    source_language: str = "en"
    stack: str | None = None
    fmt: str | None = None
    resource_dir: str | None = None
    base_name: str = "Strings"
    work_dir: str | None = None            # cache, state and log; default below the project
    scan_only: bool = False
    apply: bool = False
    retranslate: bool = False
    include_diagnostics: bool = False
    use_cache: bool = True
    apply_setup: bool = False
    context: str = ""
    glossary: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_files: int = 0
    batch_size: int = fixed.BATCH_SIZE
    concurrency: int = fixed.CONCURRENCY

    @property
    def work(self) -> str:
        return self.work_dir or os.path.join(self.project, ".glossweave")

    def validate(self) -> "RunOptions":
        from .sources.bundles import get

        if not self.languages and not self.scan_only:
            raise ValueError("at least one language is needed")
        for tag in (self.source_language, *self.languages):
            if not re.match(KNOWN_SHAPE, tag):
                raise ValueError(f"{tag!r} is not a language tag")
        if self.fmt:
            get(self.fmt)
        if not 1 <= self.batch_size <= 100:
            raise ValueError("batch size must be 1..100")
        if not 1 <= self.concurrency <= 16:
            raise ValueError("concurrency must be 1..16")
        return self


LISTS = ("languages", "glossary", "exclude")


def merge_config(config: dict, flags: dict) -> RunOptions:
    """Flags override single values of the configuration; lists are joined, ignoring case."""
    known = {f.name for f in fields(RunOptions)}
    unknown = set(config) | set(flags)
    if unknown - known:
        raise ValueError(f"unknown option {sorted(unknown - known)[0]!r}")
    merged = {**config, **{k: v for k, v in flags.items() if v is not None}}
    for name in LISTS:
        seen = {}
        for value in [*config.get(name, ()), *flags.get(name, ())]:
            seen.setdefault(value.lower(), value)
        merged[name] = tuple(seen.values())
    return RunOptions(**merged)


def load(path: str, **flags) -> RunOptions:
    with open(path, encoding="utf-8") as f:
        return merge_config(json.load(f), flags)


def with_stack(options: RunOptions, stack: str) -> RunOptions:
    """Fills what follows from the stack."""
    return replace(
        options, stack=stack, fmt=options.fmt or fixed.DEFAULT_FORMAT[stack], resource_dir=options.resource_dir or fixed.DEFAULT_DIRECTORY[stack])


def to_dict(options: RunOptions) -> dict:
    return asdict(options)
