"""Map, reduce and link jobs as data, and their JSON form."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

#: Milliseconds a job may take by default.
DEFAULT_TIMEOUT = 60_000


class BadJob(ValueError):
    pass


@dataclass(frozen=True)
class Inputs:
    """Where inputs come from: keys, bucket, filtered, index or generator."""

    kind: str
    bucket: str | None = None
    bucket_type: str = "default"
    keys: tuple[tuple, ...] = ()
    chain: tuple = ()
    field: str | None = None
    start: Any = None
    end: Any = None
    function: str | Callable | None = None
    arg: Any = None


@dataclass(frozen=True)
class Phase:
    """A step: map, reduce or link; ``keep`` returns its output too."""

    kind: str
    function: str | Callable | None = None
    arg: Any = None
    keep: bool = False
    bucket: str = "_"
    tag: str = "_"


@dataclass(frozen=True)
class Job:
    inputs: Inputs
    phases: tuple[Phase, ...] = ()
    timeout: int = DEFAULT_TIMEOUT


def _bucket(value: Any) -> tuple[str, str]:
    """(type, name) of a name or a pair."""
    if isinstance(value, str):
        return "default", value
    if isinstance(value, (list, tuple)) and len(value) == 2 and all(isinstance(x, str) for x in value):
        return value[0], value[1]
    raise BadJob(f"not a bucket: {value!r}")


def _tuples(value: Any) -> Any:
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


def parse_inputs(value: Any) -> Inputs:
    """Tried in turn: generator, search, index, filtered bucket, bucket, keys."""
    if isinstance(value, dict):
        if "module" in value and "function" in value:
            return Inputs("generator", function=f"{value['module']}:{value['function']}", arg=value.get("arg"))
        if "bucket" in value and "query" in value:
            raise BadJob("search is not enabled")
        if "bucket" in value and "index" in value:
            kind, name = _bucket(value["bucket"])
            if "key" in value:
                return Inputs("index", name, kind, field=value["index"], start=value["key"], end=value["key"])
            if "start" in value and "end" in value:
                return Inputs("index", name, kind, field=value["index"], start=value["start"], end=value["end"])
            raise BadJob("an index input needs key, or start and end")
        if "bucket" in value and "key_filters" in value:
            kind, name = _bucket(value["bucket"])
            if not value["key_filters"]:
                raise BadJob("key_filters is empty")
            return Inputs("filtered", name, kind, chain=_tuples(value["key_filters"]))
        raise BadJob(f"not inputs: {value!r}")
    if isinstance(value, str):
        return Inputs("bucket", value)
    if isinstance(value, (list, tuple)):
        if not value:
            raise BadJob("inputs are empty")
        if len(value) == 2 and all(isinstance(x, str) for x in value):
            return Inputs("bucket", value[1], value[0])
        keys = []
        for k in value:
            if not isinstance(k, (list, tuple)) or not 2 <= len(k) <= 4:
                raise BadJob(f"not a key: {k!r}")
            bucket, key, data, kind = [*k, *[None] * (4 - len(k))]
            keys.append((kind or "default", bucket, key, data))
        return Inputs("keys", keys=tuple(keys))
    raise BadJob(f"not inputs: {value!r}")


def parse_phase(value: dict, last: bool) -> Phase:
    """``{kind: {...}}``; only the last phase is kept unless told otherwise."""
    if not isinstance(value, dict) or len(value) != 1:
        raise BadJob(f"not a phase: {value!r}")
    ((kind, body),) = value.items()
    keep = body.get("keep", last)
    if not isinstance(keep, bool):
        raise BadJob("keep is not boolean")
    if kind == "link":
        return Phase("link", keep=keep, bucket=body.get("bucket", "_"), tag=body.get("tag", "_"))
    if kind not in ("map", "reduce"):
        raise BadJob(f"no phase {kind}")
    language = body.get("language")
    if language == "erlang":
        if "source" in body or "bucket" in body:
            raise BadJob("functions given as source are not run")
        if "module" not in body or "function" not in body:
            raise BadJob("missing_field: module and function")
        name = body["function"]
    elif language == "javascript":
        if "name" not in body:
            raise BadJob("functions given as source are not run")
        name = body["name"].rpartition(".")[2]
    else:
        raise BadJob(f"no language {language!r}")
    return Phase(kind, name, body.get("arg"), keep)


def parse(body: str | dict) -> Job:
    job = json.loads(body) if isinstance(body, (str, bytes)) else body
    missing = [f for f in ("inputs", "query") if f not in job]
    if missing:
        raise BadJob(f"missing_field: {missing[0]}")
    query: Sequence = job["query"]
    if not isinstance(query, list):
        raise BadJob("query is not a list")
    timeout = job.get("timeout", DEFAULT_TIMEOUT)
    if not isinstance(timeout, int) or isinstance(timeout, bool) or timeout <= 0:
        timeout = DEFAULT_TIMEOUT
    return Job(parse_inputs(job["inputs"]), tuple(parse_phase(p, i == len(query) - 1) for i, p in enumerate(query)), timeout)
