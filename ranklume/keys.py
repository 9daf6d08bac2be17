"""The key registry: governed, typed column names.

A key has an id, a dotted name, a type and a scope.  In DataFrames its column is
named in snake case (``score.base`` -> ``score_base``) and carries the id, name
and type in its metadata.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Key types, scopes, and the form of names.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "i64": T.LongType(),
    "f32": T.FloatType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "f32vec": T.ArrayType(T.FloatType(), containsNull=False),
}
SCOPES = ("candidate", "feature", "score", "debug", "tmp", "penalty")
NAME = re.compile(r"[a-z][a-z0-9]*(\.[a-z][a-z0-9_]*)*")

#: The column that keeps row order; it isn't a key.
POSITION = "_pos"


class RegistryError(ValueError):
    """What is wrong with a registry, one message a line."""

    def __init__(self, messages: list[str]):
        super().__init__("\n".join(messages))
        self.messages = messages


@dataclass(frozen=True)
class Key:
    id: int
    name: str
    type: str
    scope: str
    owner: str = "core"
    doc: str = ""

    @property
    def column(self) -> str:
        return column_name(self.name)

    @property
    def constant(self) -> str:
        return constant_name(self.name)

    @property
    def spark_type(self) -> T.DataType:
        return TYPES[self.type]

    def field(self) -> T.StructField:
        return T.StructField(self.column, self.spark_type, True, self.metadata())

    def metadata(self) -> dict:
        return {"key_id": self.id, "key_name": self.name, "key_type": self.type}


def column_name(name: str) -> str:
    return name.replace(".", "_").lower()


def constant_name(name: str) -> str:
    return name.replace(".", "_").upper()


def check_entries(document: object) -> list[str]:
    """Messages about a parsed registry document ``{version, keys: [...]}``; none if it is valid."""
    if not isinstance(document, dict):
        return ["- (root): expected a mapping"]
    out = []
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0
    if not whole(document.get("version")):
        out.append("- version: must be a positive integer")
    entries = document.get("keys")
    if not isinstance(entries, list):
        return [*out, "- keys: must be a list"]
    for i, e in enumerate(entries):
        if not isinstance(e, dict):
            out.append(f"- keys.{i}: must be a mapping")
            continue
        rules = {
            "id": (whole, "must be a positive integer"),
            "name": (lambda v: isinstance(v, str) and NAME.fullmatch(v) is not None, "must be dotted lower-case words"),
            "type": (lambda v: v in TYPES, f"must be one of {', '.join(TYPES)}"),
            "scope": (lambda v: v in SCOPES, f"must be one of {', '.join(SCOPES)}"),
            "owner": (lambda v: isinstance(v, str) and v != "", "must not be empty"),
            "doc": (lambda v: isinstance(v, str) and v != "", "must not be empty"),
        }
        out += [f"- keys.{i}.{field}: {message}" for field, (fine, message) in rules.items() if not fine(e.get(field))]
    for field in ("id", "name"):
        seen: dict[object, int] = {}
        for i, e in enumerate(entries):
            if isinstance(e, dict) and e.get(field) is not None:
                if e[field] in seen:
                    out.append(f"- keys.{i}.{field}: duplicate {field} {e[field]} (first at keys.{seen[e[field]]})")
                seen.setdefault(e[field], i)
    return out


def parse_yaml(text: str) -> object:
    """The subset of YAML that registries use: scalars, and a list of flat mappings."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        pass

    def scalar(v: str):
        v = v.strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
            return v[1:-1]
        v = re.sub(r"\s+#.*", "", v)
        return int(v) if re.fullmatch(r"-?\d+", v) else {"true": True, "false": False, "null": None, "": None}.get(v, v)

    out: dict[str, object] = {}
    items: list[dict] | None = None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.lstrip()
        new = body.startswith("- ")
        key, colon, value = body.removeprefix("- ").partition(":")
        if not colon:
            raise RegistryError([f"- line {number}: expected 'key: value'"])
        if line[0] not in " -":
            if value.strip() and value.strip() != "[]":
                out[key.strip()] = scalar(value)
            else:
                items = out[key.strip()] = []
        elif items is None:
            raise RegistryError([f"- line {number}: an entry outside a list"])
        else:
            if new:
                items.append({})
            items[-1][key.strip()] = scalar(value)
    return out


class KeyRegistry:
    """Keys by id and by name."""

    def __init__(self, keys: Iterable[Key], version: int = 1):
        self.version = version
        self.keys = tuple(keys)
        self._by_id = {k.id: k for k in self.keys}
        self._by_name = {k.name: k for k in self.keys}
        unknown = [f"- {k.name}: unknown type {k.type}" for k in self.keys if k.type not in TYPES]
        if len(self._by_id) < len(self.keys) or len(self._by_name) < len(self.keys):
            unknown.append("- keys: duplicate id or name")
        if unknown:
            raise RegistryError(unknown)

    @classmethod
    def from_document(cls, document: object) -> KeyRegistry:
        if messages := check_entries(document):
            raise RegistryError(messages)
        return cls([Key(**{f: e[f] for f in ("id", "name", "type", "scope", "owner", "doc")}) for e in document["keys"]], document["version"])

    @classmethod
    def load(cls, path: str | Path) -> KeyRegistry:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return cls.from_document(json.loads(text))
        return cls.from_document(parse_yaml(text))

    @classmethod
    def default(cls) -> KeyRegistry:
        return cls(DEFAULT_KEYS)

    def by_id(self, key_id: int) -> Key | None:
        return self._by_id.get(key_id)

    def by_name(self, name: str) -> Key | None:
        return self._by_name.get(name)

    def resolve(self, key: int | str | Key) -> Key:
        found = key if isinstance(key, Key) else self.by_id(key) if isinstance(key, int) else self.by_name(key)
        if found is None:
            raise KeyError(f"Unknown key: {key}")
        return found

    def struct(self, *keys: int | str) -> T.StructType:
        return T.StructType([self.resolve(k).field() for k in keys] if keys else [k.field() for k in self.keys])

    def document(self) -> dict:
        return {"version": self.version, "keys": [asdict(k) for k in self.keys]}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = "key_id int, name string, type string, scope string, owner string, doc string, column_name string"
        return spark.createDataFrame([(k.id, k.name, k.type, k.scope, k.owner, k.doc, k.column) for k in self.keys], schema)

    def check(self, key: Key, value: object) -> None:
        """Raises if a row-level value doesn't fit the key; null fits every key."""
        if value is None:
            return
        fits = {
            "bool": lambda v: isinstance(v, bool),
            "i64": lambda v: isinstance(v, int) and not isinstance(v, bool),
            "f32": lambda v: isinstance(v, float),
            "string": lambda v: isinstance(v, str),
            "bytes": lambda v: isinstance(v, (bytes, bytearray)),
            "f32vec": lambda v: isinstance(v, (list, tuple)) and all(isinstance(x, float) for x in v),
        }
        if not fits[key.type](value):
            raise TypeError(f"Type mismatch for key {key.id} ({key.name}): expected {key.type}")


# The default registry.
DEFAULT_KEYS = (
    Key(1001, "cand.candidate_id", "i64", "candidate", "core", "Unique candidate identifier"),
    Key(2001, "feat.freshness", "f32", "feature", "core", "Freshness of the candidate"),
    Key(2002, "feat.embedding", "f32vec", "feature", "core", "Embedding of the candidate"),
    Key(2003, "feat.query_embedding", "f32vec", "feature", "core", "Embedding of the query"),
    Key(3001, "score.base", "f32", "score", "core", "Score from retrieval"),
    Key(3002, "score.ml", "f32", "score", "core", "Score from a model"),
    Key(3003, "score.adjusted", "f32", "score", "core", "Score after adjustments"),
    Key(3999, "score.final", "f32", "score", "core", "Score that ranks"),
    Key(4001, "penalty.constraints", "f32", "penalty", "core", "Penalty of constraints"),
    Key(4002, "penalty.diversity", "f32", "penalty", "core", "Penalty of diversity"),
    Key(9001, "debug.node_timings", "string", "debug", "core", "Timings of nodes"),
)
