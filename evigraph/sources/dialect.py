"""Vocabularies: ladders of source classes, extra relations, subtypes and rule levels; built in or from a YAML file."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from evigraph.model import BODY_KEYS, CORE_EDGES, INVERSE_KEYS, KINDS, SCALAR_KEYS


@dataclass(frozen=True)
class Dialect:
    """``ladder`` runs from the strongest class down; ``governs`` is the class without a rank."""

    name: str
    ladder: tuple[str, ...]
    governs: str
    speakers: tuple[str, ...] = ()
    edges: tuple[str, ...] = ()
    subtypes: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)  # name: (kinds, keys)
    rules: dict[str, str] = field(default_factory=dict)
    content_hash: str = ""

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.ladder, self.governs)

    def rank(self, cls: str) -> int | None:
        return len(self.ladder) - 1 - self.ladder.index(cls) if cls in self.ladder else None

    def ranks(self, spark: SparkSession) -> DataFrame:
        """(class, rank) of the ranked classes: a handful of rows."""
        return spark.createDataFrame([(c, self.rank(c)) for c in self.ladder], "class string, rank int")


# The two built-in vocabularies, strongest class first.
LEGAL = Dialect(
    "legal", ("record", "admission", "document", "observation", "statement", "interested", "inference"), "authority",
    speakers=("admission", "interested"), edges=("serves", "targets", "counters", "pursues", "produced", "pleaded_as"),
)
ENGINEERING = Dialect("engineering", ("measured", "observed", "signed-off", "accepted", "reported", "inference"), "decided")
BUILT_IN = {d.name: d for d in (LEGAL, ENGINEERING)}


def parse_dialect(text: str, name: str | None = None) -> Dialect:
    """A dialect file: name, ladder, governs, speaker_required, edges, subtypes, rules. ValueError for what it may not say."""
    import yaml

    raw = yaml.safe_load(text) or {}
    known = {"name", "ladder", "governs", "invalidated", "speaker_required", "edges", "subtypes", "rules"}
    wrong = [f"unknown key {k!r}" for k in raw if k not in known]
    ladder = tuple(str(x) for x in raw.get("ladder") or ())
    governs = str(raw.get("governs") or "")
    if not ladder:
        wrong.append("a ladder is needed")
    if len(set(ladder)) < len(ladder):
        wrong.append("a class stands twice on the ladder")
    if not governs or governs in ladder:
        wrong.append("the governing class must be named and have no rank")
    speakers = tuple(raw.get("speaker_required") or ())
    wrong += [f"{c!r} requires a speaker but is no class" for c in speakers if c not in ladder]
    edges = tuple(raw.get("edges") or {})
    taken = {*CORE_EDGES, *INVERSE_KEYS, *KINDS, *BODY_KEYS, *SCALAR_KEYS, "id", "is"}
    wrong += [f"{e!r} is a word of the core" for e in edges if e in taken]
    subtypes = {}
    for k, v in (raw.get("subtypes") or {}).items():
        kinds = v.get("kind") or ()
        kinds = (kinds,) if isinstance(kinds, str) else tuple(kinds)
        keys = tuple(v.get("keys") or ())
        wrong += [f"subtype {k!r} is of an unknown kind {x!r}" for x in kinds if x not in KINDS]
        wrong += [f"subtype {k!r} redefines {x!r}" for x in keys if x in taken]
        subtypes[k] = (kinds, keys)
    rules = {str(k): str(v) for k, v in (raw.get("rules") or {}).items()}
    wrong += [f"rule {k!r} has no level {v!r}" for k, v in rules.items() if v not in ("error", "warn", "off")]
    if wrong:
        raise ValueError("; ".join(wrong))
    return Dialect(str(raw.get("name") or name or ""), ladder, governs, speakers, edges, subtypes, rules, hashlib.sha256(text.strip().encode()).hexdigest()[:16])


def resolve(name: str | None, project: dict[str, Dialect] | None = None, corpus: dict[str, Dialect] | None = None) -> Dialect:
    """A dialect by name: the project's, then the corpus-wide, then the built-in one; no name is legal."""
    for known in (project or {}, corpus or {}, BUILT_IN):
        if (name or "legal") in known:
            return known[name or "legal"]
    names = sorted({*(project or {}), *(corpus or {}), *BUILT_IN})
    raise ValueError(f"unknown dialect {name!r}; known: {', '.join(names)}")


@dataclass(frozen=True)
class Index:
    """A declared corpus: its name, dialect and rule levels."""

    name: str
    dialect: str = ""
    rules: dict[str, str] = field(default_factory=dict)


def parse_index(text: str, checks: tuple[str, ...] = ()) -> Index:
    """A marker file: a bare name, or lines of ``index:``, ``dialect:`` and ``rule.<check>:``."""
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    if len(lines) == 1 and ":" not in lines[0]:
        return Index(lines[0])
    seen: dict[str, str] = {}
    for line in lines:
        key, sep, value = (x.strip() for x in line.partition(":"))
        if not sep or not value:
            raise ValueError(f"not `key: value`: {line!r}")
        if key in seen:
            raise ValueError(f"{key!r} stands twice")
        if key not in ("index", "dialect") and not key.startswith("rule."):
            raise ValueError(f"unknown key {key!r}")
        if key.startswith("rule."):
            if checks and key[5:] not in checks:
                raise ValueError(f"unknown check {key[5:]!r}")
            if value not in ("error", "warn", "off"):
                raise ValueError(f"{key} has no level {value!r}")
        seen[key] = value
    if "index" not in seen:
        raise ValueError("no index is named")
    return Index(seen["index"], seen.get("dialect", ""), {k[5:]: v for k, v in seen.items() if k.startswith("rule.")})


def index_of(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``files(path, dir)`` with the index of the nearest marker at or above ``dir``, from ``markers(dir, idx)``; none is ''.

    Markers are few; each file's ancestor folders are exploded and joined by equality, so no prefix scan is needed.
    """
    from pyspark.sql import functions as F

    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    steps = files.select("path", F.explode(up).alias("above"))
    found = steps.join(F.broadcast(markers.select(F.col("dir").alias("above"), "idx")), "above").groupBy("path").agg(F.max_by("idx", F.length("above")).alias("idx"))
    return files.join(found, "path", "left").withColumn("idx", F.coalesce("idx", F.lit("")))
