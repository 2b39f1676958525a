"""JSON spellings of the Request message, and its logical record graph.

Producers differ in the spelling of keys (case, separators), in writing numbers as text, a list
of one as its only element, a list as an object keyed by position or as JSON text, and in
wrapping the message in an envelope.  ``decode_requests`` maps them all onto the same nested
record, with the flat timer lists regrouped into timers and dictionary offsets resolved.
"""

from __future__ import annotations

import math
import re

from ..operators.nested import Child, Element, NestedShredder, read_json, write_json

_SCALARS = (
    ("hostname", "string"), ("server_name", "string"), ("script_name", "string"), ("schema", "string"),
    ("request_count", "bigint"), ("document_size", "bigint"), ("memory_peak", "bigint"), ("memory_footprint", "bigint"), ("status", "bigint"),
    ("request_time", "double"), ("ru_utime", "double"), ("ru_stime", "double"), ("sound", "boolean"),
)
GRAPH = {
    e.name: e
    for e in (
        Element("envelope", (), (Child("message", "request", True),)),
        Element("request", _SCALARS, (Child("requests", "request", True), Child("timers", "timer", True), Child("tags", "tag", True))),
        Element("timer", (("hit_count", "bigint"), ("timer_value", "double"), ("timer_ru_utime", "double"), ("timer_ru_stime", "double")), (Child("tags", "tag", True),)),
        Element("tag", (("tag_name", "string"), ("tag_value", "string"))),
    )
}
_LISTS = ("timer_hit_count", "timer_value", "timer_tag_count", "timer_tag_name", "timer_tag_value", "timer_ru_utime", "timer_ru_stime", "tag_name", "tag_value", "dictionary", "requests")
_BARE = {n.replace("_", ""): n for n in (*_LISTS, *(c for c, _ in _SCALARS if c != "sound"))}
_ENVELOPES = ("msg", "message", "payload", "request", "data", "body")


def bare_key(key: str) -> str:
    return "".join(ch for ch in key.lower() if ch.isalnum())


def _number(v) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v.strip() if isinstance(v, str) else v)
    except (TypeError, ValueError, OverflowError):
        return None


def _whole(v) -> int | None:
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    if isinstance(v, str) and re.fullmatch(r"\s*[+-]?\d{1,400}\s*", v):
        return int(v)
    n = _number(v)
    return int(n) if n is not None and math.isfinite(n) and n == int(n) else None


def _bigint(v) -> int | None:
    n = _whole(v)
    return n if n is None or -(2**63) <= n < 2**63 else None


def _list(v, words: bool = False) -> list:
    """Any spelling of a list as a list."""
    if v is None:
        return []
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{") and (inner := read_json(v)) is not None:
        v = inner
    if isinstance(v, dict):
        if all(re.fullmatch(r"\d{1,18}", k) for k in v):
            return [v[k] for k in sorted(v, key=int)]
        return [v]
    if isinstance(v, list):
        return v
    return [v] if words or v != "" else []


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else write_json(v)


def _fields(o: dict) -> dict:
    out: dict = {}
    for k, v in o.items():
        if (name := _BARE.get(bare_key(k))) and out.get(name) is None:
            out[name] = v
    return out


def _objects(v) -> list[dict | None]:
    return [x if isinstance(x, dict) else (i if isinstance(x, str) and isinstance(i := read_json(x), dict) else None) for x in _list(v)]


def _timers(f: dict, words: list[str] | None) -> list[dict] | None:
    """Timers regrouped by timer_tag_count; None if the lists contradict each other or the dictionary."""
    hits, values, counts = ([_whole(x) for x in _list(f.get("timer_hit_count"))], [_number(x) for x in _list(f.get("timer_value"))], [_whole(x) for x in _list(f.get("timer_tag_count"))])
    names, vals = [_whole(x) for x in _list(f.get("timer_tag_name"))], [_whole(x) for x in _list(f.get("timer_tag_value"))]
    if not len(hits) == len(values) == len(counts) or any(c is None or c < 0 for c in counts) or any(h is None for h in hits):
        return None
    if not sum(counts) == len(names) == len(vals):
        return None
    n = len(words or ())
    if any(x is None or not 0 <= x < n for x in (*names, *vals)):
        return None
    ut, st = ([_number(x) for x in _list(f.get(k))] for k in ("timer_ru_utime", "timer_ru_stime"))
    out, at = [], 0
    for i, c in enumerate(counts):
        tags = [{"tag_name": words[a], "tag_value": words[b]} for a, b in zip(names[at : at + c], vals[at : at + c])]
        at += c
        h = hits[i] if -(2**63) <= hits[i] < 2**63 else None
        out.append({"hit_count": h, "timer_value": values[i], "timer_ru_utime": ut[i] if i < len(ut) else None, "timer_ru_stime": st[i] if i < len(st) else None, "tags": tags})
    return out


def _message(text: str) -> dict | list | None:
    """What the envelopes of a payload hold; None if it isn't whole JSON or holds no message."""
    v = read_json(text)
    while True:  # ends: every step goes one deeper into a finite text
        if isinstance(v, str):
            v = read_json(v)
        if not isinstance(v, dict) or len(_fields(v)) > 1:
            break
        inner = [x for k, x in v.items() if bare_key(k) in _ENVELOPES]
        if not inner:
            break
        v = inner[0]
    return v if isinstance(v, (dict, list)) else None


def decode_requests(text: str) -> list[dict | None] | None:
    """The logical records of a payload; None if it isn't whole JSON or holds no message."""
    v = _message(text)
    if v is None:
        return None
    tops: list = [None if o is None else {"__raw": o, "__words": None} for o in _objects(v)]
    work = [t for t in tops if t is not None]
    while work:
        t = work.pop()
        f, words = _fields(t.pop("__raw")), t.pop("__words")
        own = [_text(w) or "" for w in _list(f.get("dictionary"), words=True)]
        words = own or words
        timers = _timers(f, words)
        t |= {c: (_text(f.get(c)) if kind == "string" else _bigint(f.get(c)) if kind == "bigint" else _number(f.get(c))) for c, kind in _SCALARS if c != "sound"}
        t["sound"] = timers is not None
        t["timers"] = timers or []
        a, b = [_whole(x) for x in _list(f.get("tag_name"))], [_whole(x) for x in _list(f.get("tag_value"))]
        n = len(words or ())
        t["tags"] = [{"tag_name": words[x], "tag_value": words[y]} for x, y in zip(a, b) if x is not None and y is not None and 0 <= x < n and 0 <= y < n]
        t["requests"] = [None if o is None else {"__raw": o, "__words": words} for o in _objects(f.get("requests"))]
        work += [k for k in t["requests"] if k is not None]
    return tops


def request_shredder() -> NestedShredder:
    return NestedShredder(GRAPH, "envelope", "request", decode_requests, lambda text: _message(text) is not None)
