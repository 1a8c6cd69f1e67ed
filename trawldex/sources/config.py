"""Settings: sites to index, search limits, request identity. Validated on construction."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trawldex.sources import files


@dataclass(frozen=True)
class Site:
    url: str
    name: str


@dataclass(frozen=True)
class WebRequest:
    user_agent: str = "trawldex"
    referrer: str = ""
    accept_language: str = "ru"


@dataclass(frozen=True)
class Settings:
    """snippet_radius: words on each side of a hit; max_relative_frequency: lemmas on a greater share of a site's pages are
    dropped from queries."""

    sites: tuple[Site, ...] = ()
    snippet_radius: int = 3
    max_relative_frequency: float = 0.95
    debug: bool = False
    web_request: WebRequest = field(default_factory=WebRequest)

    def __post_init__(self) -> None:
        if self.snippet_radius < 1:
            raise ValueError("snippet_radius must be at least 1")
        if not 0 <= self.max_relative_frequency <= 1:
            raise ValueError("max_relative_frequency must be between 0 and 1")
        if bad := [s.url for s in self.sites if s.url.endswith("/")]:
            raise ValueError(f"site urls must not end in a slash: {bad}")

    @classmethod
    def from_mapping(cls, raw: Mapping) -> Settings:
        """From the nested mapping of a configuration file (keys application, search, web-request, sites)."""
        app = raw.get("application", raw)
        search, request = app.get("search", {}), app.get("web-request", {})
        return cls(
            sites=tuple(Site(s["url"], s["name"]) for s in app.get("sites", [])),
            snippet_radius=int(search.get("snippet-radius", 3)),
            max_relative_frequency=float(search.get("max-relative-frequency", 0.95)),
            debug=bool(app.get("debug", False)),
            web_request=WebRequest(request.get("user-agent", "trawldex"), request.get("referrer", ""), request.get("accept-language", "ru")),
        )

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Settings:
        """From a YAML file in any store that Spark reads."""
        return cls.from_mapping(parse_yaml(files.text(spark, path)))

    def site_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.url, s.name) for s in self.sites], "url string, name string")


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None if text in ("", "~", "null") else text


def parse_yaml(text: str):
    """The part of YAML that settings use: nested mappings and lists by indentation, plain and quoted scalars, comments."""
    lines = []
    for raw in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", raw) if not re.search(r"['\"].*#", raw) else raw
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip(" ")), body.strip()))
    at = 0

    def block(indent: int):
        nonlocal at
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            dash = body.startswith("- ") or body == "-"
            if out is not None and dash != isinstance(out, list):
                break  # a list may stand at the indentation of the name that it belongs to
            if dash:
                out = [] if out is None else out
                inner = body[1:].lstrip()
                if re.match(r"[^'\"{\[][^:]*:(\s|$)", inner):  # a mapping begins on the dash's line
                    lines[at] = (indent + len(body) - len(inner), inner)
                    out.append(block(lines[at][0]))
                else:
                    at += 1
                    out.append(_scalar(inner) if inner else block(lines[at][0]))
                continue
            name, colon, rest = body.partition(":")
            if not colon:
                raise ValueError(f"not a mapping: {body}")
            out = {} if out is None else out
            at += 1
            if rest.strip():
                out[_scalar(name)] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[_scalar(name)] = block(lines[at][0])
            else:
                out[_scalar(name)] = None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"unexpected indentation: {lines[at][1]}")
        return out

    return block(lines[0][0]) if lines else {}
