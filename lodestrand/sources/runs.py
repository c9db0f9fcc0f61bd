"""Run records, hook payloads, configuration and templates."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_SCHEMA = "session_id string, started_at timestamp, finished_at timestamp, touched_pages array<string>, error string, input_tokens bigint, output_tokens bigint"
PAYLOAD_FIELDS = ("session_id", "transcript_path", "cwd", "hook_event_name")
MAX_PAYLOAD_BYTES = 1 << 20


def last_runs(lines: DataFrame, n: int) -> DataFrame:
    """Of lines(line_no, raw) the last n physical lines, then those of them that are records: maybe fewer than n."""
    tail = lines.orderBy(F.desc("line_no")).limit(n)
    rows = tail.select("line_no", F.from_json("raw", RUN_SCHEMA).alias("r")).where("r.session_id IS NOT NULL AND r.started_at IS NOT NULL AND r.finished_at IS NOT NULL")
    return rows.select("line_no", "r.*").orderBy("line_no")


def parse_payloads(lines: DataFrame, *keep: str) -> DataFrame:
    """lines(raw) as payload columns and an error for those that are too large or lack a field, with the columns to keep; further keys are ignored."""
    got = F.from_json("raw", "session_id string, transcript_path string, cwd string, permission_mode string, hook_event_name string, agent_id string, agent_type string")
    rows = lines.withColumn("p", F.when(F.octet_length("raw") <= MAX_PAYLOAD_BYTES, got))
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.col("p")[f].isNull(), F.lit(f)) for f in PAYLOAD_FIELDS])), ", ")
    error = F.when(F.octet_length("raw") > MAX_PAYLOAD_BYTES, "payload too large").when(lacks != "", F.concat(F.lit("missing "), lacks))
    return rows.select(*keep, "p.*", error.alias("error"))


@dataclass(frozen=True)
class Config:
    """[default] of a configuration file; profiles are accepted and unused."""

    vault_path: str
    subdir: str = "Notes"
    recipe: str = "dev-journal"
    model: str | None = None
    backend: str | None = None
    keep_source_summaries: bool = False
    skip_paths: tuple[str, ...] = ()
    vault_language: str | None = None

    @classmethod
    def parse(cls, text: str) -> Config:
        got = tomllib.loads(text)["default"]
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in cls.__dataclass_fields__})

    def dump(self) -> str:
        show = lambda v: json.dumps(list(v) if isinstance(v, tuple) else v, ensure_ascii=False)
        return "[default]\n" + "".join(f"{k} = {show(v)}\n" for k, v in self.__dict__.items() if v is not None)


@dataclass(frozen=True)
class Template:
    """A request template; caps are in bytes. Limits that no recipe sets are None."""

    system: str
    user: str
    model: str | None = None
    max_tokens: int = 4096
    max_facts: int | None = None
    max_body_chars: int | None = None
    caps: dict[str, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, base: str, recipe: str | None = None) -> Template:
        """A base template with tables meta, byte_caps and prompt; a recipe over it, with tables meta, overrides and prompt_overrides: its
        model and token bound replace, its limits are set, and its extra_system is appended as it is."""
        got = tomllib.loads(base)
        over = tomllib.loads(recipe) if recipe else {}
        meta, limits = got.get("meta", {}) | {k: v for k, v in over.get("meta", {}).items() if k in ("model", "max_tokens")}, over.get("overrides", {})
        system = got["prompt"]["system"] + over.get("prompt_overrides", {}).get("extra_system", "")
        return cls(system, got["prompt"]["user_template"], meta.get("model"), meta.get("max_tokens", 4096), limits.get("max_facts_per_session"), limits.get("max_body_chars"), got.get("byte_caps", {}))

    @classmethod
    def load(cls, folder: str, recipe: str = "default", base: str = "distill") -> Template:
        """base.toml of a folder, and recipes/<recipe>.toml over it unless that is "default"."""
        from pathlib import Path

        read = lambda name: Path(folder, f"{name}.toml").read_text(encoding="utf-8")
        return cls.parse(read(base), None if recipe == "default" else read(f"recipes/{recipe}"))


def install_templates(folder: str) -> list[str]:
    """Writes the package's templates and recipes below a folder of the driver, for the user to edit. Files that are there stay as they are.
    Gives the names of those written."""
    from importlib import resources
    from pathlib import Path

    from lodestrand.sources.sinks import write_atomic

    written = []
    for part in ("", "recipes"):
        for entry in sorted(resources.files("lodestrand.prompts").joinpath(part).iterdir(), key=lambda e: e.name):
            target = Path(folder, part, entry.name)
            if entry.name.endswith(".toml") and not target.exists():
                write_atomic(target, entry.read_text(encoding="utf-8"))
                written.append(f"{part}/{entry.name}".lstrip("/"))
    return written
