"""Configuration: defaults, then a YAML file, then what the command line sets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from weft.functions.timestamps import SEARCH_LIMIT, SHORTEST, TimestampOptions, nanos
from weft.operators.render import RenderOptions
from weft.plans.merge import MergeOptions

# The YAML file's names of the fields below.
YAML_NAMES = {
    "InputPaths": "inputs", "IgnorePatterns": "exclude", "IgnoreArchives": "ignore_archives", "LogFile": "log", "MetricsTreeEnabled": "metrics", "PrintProgressEnabled": "progress", "FileAliases": "aliases", "FollowSymlinks": "follow_symlinks", "OutputFile": "output", "WriteTimestampPerLine": "write_timestamp", "WriteAliasPerLine": "write_line_alias", "WriteAliasPerBlock": "write_block_alias",
    "WriteLevelPerLine": "write_level", "StripOriginalTimestamp": "strip_timestamp", "StripOriginalLevel": "strip_level", "MinTimestamp": "since", "MaxTimestamp": "until", "IgnoreTimezoneInfo": "ignore_timezone", "ShortestTimestampLen": "min_ts_len", "TimestampSearchEndIndex": "ts_search_limit",
}


@dataclass
class Config:
    inputs: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    ignore_archives: bool = False
    follow_symlinks: bool = False
    output: str | None = None
    log: str | None = None
    progress: bool = False
    write_timestamp: bool = False
    write_level: bool = False
    write_line_alias: bool = False
    write_block_alias: bool = False
    strip_timestamp: bool = False
    strip_level: bool = False
    since: str | None = None
    until: str | None = None
    ignore_timezone: bool = False
    min_ts_len: int = SHORTEST
    ts_search_limit: int = SEARCH_LIMIT
    order: str = "stable"
    threshold: int | None = None
    further: bool = False
    anchor_by_modification: bool = False
    timestamp_format: str | None = None
    zone: str | None = None
    drop_orphans: bool = False
    metrics: bool = False
    dry_run: bool = False

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """Names are looked up at any depth; those not known here are left out."""
        import yaml

        class Loader(yaml.SafeLoader):
            """Times stay text, with all their digits."""

        Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        known, out = {f.name for f in fields(cls)}, cls()

        def take(node: Any) -> None:
            for k, v in node.items():
                name = YAML_NAMES.get(k, k)
                if name in known and v is not None:
                    setattr(out, name, v)
                elif isinstance(v, dict):
                    take(v)

        take(yaml.load(text, Loader) or {})
        return out

    def overlaid(self, given: dict[str, Any]) -> Config:
        """With the values that were given explicitly."""
        return Config(**{f.name: given.get(f.name, getattr(self, f.name)) for f in fields(self)})

    def merge_options(self) -> MergeOptions:
        return MergeOptions(
            since=nanos(self.since) if self.since else None, until=nanos(self.until) if self.until else None, drop_orphans=self.drop_orphans, order=self.order, threshold=self.threshold, anchor_by_modification=self.anchor_by_modification,
            timestamps=TimestampOptions(self.ts_search_limit, self.min_ts_len, self.ignore_timezone, self.further, self.zone),
            render=RenderOptions(self.write_timestamp, self.write_level, self.write_line_alias, self.write_block_alias, self.strip_timestamp, self.strip_level, self.timestamp_format),
        )

