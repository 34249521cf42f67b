"""Settings with their defaults; bounds keep the domain of facts and paths finite."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum, auto


class CallGraph(StrEnum):
    AUTO = auto()
    CHA = auto()
    VTA = auto()
    RTA = auto()
    SPARK = auto()
    GEOM = auto()
    ON_DEMAND = auto()


class Aliasing(StrEnum):
    FLOW_SENSITIVE = auto()
    POINTS_TO = auto()
    NONE = auto()
    LAZY = auto()


class Implicit(StrEnum):
    NONE = auto()
    ARRAY_ACCESSES = auto()
    ALL = auto()


class Statics(StrEnum):
    CONTEXT_FLOW_SENSITIVE = auto()
    CONTEXT_FLOW_INSENSITIVE = auto()
    NONE = auto()


class PathMode(StrEnum):
    NONE = auto()
    FAST = auto()
    PRECISE = auto()


class PathBuilder(StrEnum):
    CONTEXT_SENSITIVE = auto()
    CONTEXT_INSENSITIVE = auto()
    SOURCES_ONLY = auto()
    RECURSIVE = auto()
    NONE = auto()


class Direction(StrEnum):
    FORWARDS = auto()
    BACKWARDS = auto()


class CategoryMode(StrEnum):
    USE_ALL_BUT_EXCLUDED = auto()
    USE_ONLY_INCLUDED = auto()


class LayoutMatching(StrEnum):
    NONE = auto()
    ALL = auto()
    SENSITIVE_ONLY = auto()


class WrapperMode(StrEnum):
    DEFAULT = auto()
    DEFAULT_FALLBACK = auto()
    NONE = auto()
    EASY = auto()
    SUMMARIES = auto()
    MULTI = auto()


@dataclass(frozen=True)
class Bounds:
    access_path_length: int = 5
    neighbours: int = 10
    callees_per_call_site: int = 75
    fact_path_length: int = 100
    call_stack: int = 30
    path_length: int = 75
    paths_per_fact: int = 15
    constraint_depth: int = 50
    paths_per_method: int = 100
    loop_visits: int = 2
    callbacks_per_component: int = 100
    app_bytes: int = 10 << 20


@dataclass(frozen=True)
class Settings:
    """All switches of an analysis."""

    call_graph: CallGraph = CallGraph.AUTO
    aliasing: Aliasing = Aliasing.FLOW_SENSITIVE
    implicit: Implicit = Implicit.NONE
    statics: Statics = Statics.CONTEXT_FLOW_SENSITIVE
    path_mode: PathMode = PathMode.PRECISE
    path_builder: PathBuilder = PathBuilder.CONTEXT_SENSITIVE
    direction: Direction = Direction.FORWARDS
    category_mode: CategoryMode = CategoryMode.USE_ALL_BUT_EXCLUDED
    categories: frozenset[str] = frozenset()
    layout: LayoutMatching = LayoutMatching.SENSITIVE_ONLY
    wrapper: WrapperMode = WrapperMode.DEFAULT
    exceptions: bool = True
    type_checking: bool = True
    stop_after: int | None = None
    fanout: dict[int, int] = field(default_factory=lambda: {1: 5, 2: 3})
    default_fanout: int = 1
    bounds: Bounds = Bounds()

    def to_xml(self) -> str:
        from xml.sax.saxutils import escape

        def value(v):
            return ",".join(map(str, sorted(v))) if isinstance(v, frozenset) else ",".join(f"{a}:{b}" for a, b in sorted(v.items())) if isinstance(v, dict) else str(v)

        flat = {k: v for k, v in vars(self).items() if k != "bounds"} | {f"bounds.{k}": v for k, v in vars(self.bounds).items()}
        return "<configuration>" + "".join(f'<setting name="{k}">{escape(value(v))}</setting>' for k, v in flat.items()) + "</configuration>"

    @classmethod
    def from_xml(cls, text: str) -> Settings:
        import xml.etree.ElementTree as tree

        plain, bounds = {}, {}
        defaults = cls()
        for node in tree.fromstring(text):
            name, raw = node.get("name"), node.text or ""
            if name.startswith("bounds."):
                bounds[name.removeprefix("bounds.")] = int(raw)
                continue
            old = getattr(defaults, name)
            if isinstance(old, StrEnum):
                plain[name] = type(old)(raw)
            elif isinstance(old, bool):
                plain[name] = raw == "True"
            elif isinstance(old, frozenset):
                plain[name] = frozenset(raw.split(",")) if raw else frozenset()
            elif isinstance(old, dict):
                plain[name] = {int(a): int(b) for a, b in (x.split(":") for x in raw.split(",") if x)}
            else:
                plain[name] = None if raw in ("", "None") else int(raw)
        return cls(**plain, bounds=Bounds(**bounds))
