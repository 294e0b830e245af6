"""File sources: profiles and projects in Markdown, watchlists, snapshots and feedback in JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The headings that a profile's and a project's parts stand under.
TIER_HEADINGS = {"core": "Core keywords", "proxy": "Proxy keywords", "eco": "Eco-context keywords"}

VENUE_SCHEMA = "kind string, journal string, issn string, family string, venue string, query string, aliases array<string>, pool string, scope_note string, source string"
FEEDBACK_SCHEMA = "paper_id long, stable_id string, rating string, reading_status string, action string, note string, related_project string, project string, timestamp string"


@dataclass(frozen=True)
class Profile:
    name: str
    description: str
    keywords: dict[str, list[str]]
    weekly_capacity: int = 25
    caps: dict[str, int] = field(default_factory=lambda: {"A": 5, "B": 10, "C": 10})


@dataclass(frozen=True)
class Project:
    name: str
    sections: dict[str, str]
    keywords: list[str]

    @property
    def prompt(self) -> str:
        """The project as a judge is told of it: every part that its file has."""
        parts = [f"Project: {self.name}", *(f"{heading.title()}: {body}" for heading, body in self.sections.items() if body)]
        return "\n".join([*parts, *(["Keywords: " + ", ".join(self.keywords)] if self.keywords else [])])


def sections(text: str) -> dict[str, str]:
    """The text under each `##` heading, by the heading in lower case."""
    parts = re.split(r"(?m)^##[ \t]+(.+?)[ \t]*$", text)
    return {h.lower(): body.strip() for h, body in zip(parts[1::2], parts[2::2], strict=True)}


def bullets(text: str) -> list[str]:
    return [m.strip() for m in re.findall(r"(?m)^[ \t]*[-*][ \t]+(\S.*)$", text)]


def labelled(text: str) -> dict[str, str]:
    """Lines of the form `- **Label:** value`."""
    return {k.lower(): v.strip() for k, v in re.findall(r"(?m)^-[ \t]*\*\*(.+?):\*\*[ \t]*(\S.*)$", text)}


def slug(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9一-鿿]+", "-", text).strip("-").lower()[:80] or "item"


def parse_profile(text: str, stem: str = "profile") -> Profile:
    found, labels = sections(text), labelled(text)
    intro = re.sub(r"(?m)\A#.*$", "", text).split("\n##", 1)[0].strip()
    caps = {p: int(labels.get(f"max {p.lower()}", d)) for p, d in (("A", 5), ("B", 10), ("C", 10))}
    return Profile(
        slug(labels.get("profile name", stem.removeprefix("profile-"))),
        found.get("research description") or intro,
        {t: bullets(found.get(h.lower(), "")) for t, h in TIER_HEADINGS.items()},
        int(labels.get("weekly reading capacity", "25").split()[0]),
        caps,
    )


def parse_project(text: str, stem: str = "project") -> Project:
    title = re.search(r"(?m)^#[ \t]+(.+)$", text)
    found = sections(text)
    return Project(title[1].strip() if title else stem, {k: v for k, v in found.items() if k != "keywords"}, bullets(found.get("keywords", "")))


def read_whole(spark: SparkSession, path: str) -> str:
    """A small text file from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_profile(spark: SparkSession, path: str) -> Profile:
    return parse_profile(read_whole(spark, path), path.rstrip("/").rpartition("/")[2].removesuffix(".md"))


def read_project(spark: SparkSession, path: str) -> Project:
    return parse_project(read_whole(spark, path), path.rstrip("/").rpartition("/")[2].removesuffix(".md"))


def read_venues(spark: SparkSession, *paths: str) -> DataFrame:
    """Watchlists of journals and conferences as one table."""
    return spark.read.schema(VENUE_SCHEMA).json(list(paths), multiLine=True)


def read_snapshot(spark: SparkSession, path: str, record: str, parts: tuple[str, ...] = ("new", "already_seen")) -> DataFrame:
    """The records of a stage snapshot: its `papers` if it has them, else the named parts, in order."""
    schema = ", ".join(f"{p} array<{record}>" for p in ("papers", *parts))
    whole = spark.read.schema(schema).json(path, multiLine=True)
    some = F.concat(*[F.coalesce(F.col(p), F.array().cast(f"array<{record}>")) for p in parts])
    placed = whole.select(F.posexplode(F.coalesce("papers", some)).alias("at", "r")).select("at", "r.*")
    return placed.select(F.col("at").cast("long").alias("ord"), *[c for c in placed.columns if c not in ("at", "ord")])


def read_scan(spark: SparkSession, path: str, record: str, field: str = "both") -> DataFrame:
    """A scan's records, of which `field` takes the new ones, those seen before, or both.

    A snapshot of one JSON object (`.json`) has these as lists; a folder of JSON
    lines may tell them by is_new, and without it all are new.
    """
    if path.endswith(".json"):
        parts = ("new", "already_seen") if field == "both" else (field,)
        return read_snapshot(spark, path, f"struct<{_struct(record)}>", parts)
    rows = spark.read.json(path)
    if field == "both":
        return rows
    new = F.coalesce("is_new", F.lit(True)) if "is_new" in rows.columns else F.lit(True)
    return rows.filter(new if field == "new" else ~new)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records of `{"profile": ..., "feedback": [...]}` or of a bare list, with ord and profile."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    wrapped = F.from_json("v", f"profile string, feedback array<struct<{_struct(FEEDBACK_SCHEMA)}>>")
    bare = F.from_json("v", f"array<struct<{_struct(FEEDBACK_SCHEMA)}>>")
    is_list = F.col("v").startswith("[")
    rows = text.select(F.when(~is_list, wrapped["profile"]).alias("profile"), F.when(is_list, bare).otherwise(wrapped["feedback"]).alias("records"))
    return rows.select("profile", F.posexplode("records").alias("ord", "r")).select("ord", "profile", "r.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.rsplit(" ", 1) for part in ddl.split(", ")))


def resolve(path: str, base: str) -> str:
    """A path as it is, if it is absolute or an address, else below the base."""
    return path if path.startswith("/") or re.match(r"[a-z][a-z0-9+.-]*:", path) else f"{base.rstrip('/')}/{path}"


def read_settings(spark: SparkSession, path: str, overrides: dict) -> dict:
    """The settings of a JSON file, with overrides on top."""
    return merged(json.loads(read_whole(spark, path)), overrides)


def merged(base: dict, update: dict | None) -> dict:
    """A deep merge of settings; null overrides are dropped, dicts merge, all else replaces."""
    out = dict(base)
    for k, v in (update or {}).items():
        if v is None:
            continue
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
