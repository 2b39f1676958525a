"""Report definitions: ``v2/<kind>/<window>/<keys>/<histogram>/<filters>`` and their legacy forms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

FIELDS = ("host", "script", "server", "schema", "status")
KINDS = {"packet": "packet", "info": "packet", "request": "request", "timer": "timer", "active": "active", "stats": "stats"}
MAX_KEYS, MAX_BUCKETS, HISTOGRAM_BITS = 15, 100_000_000, 7
NS = 1_000_000_000


class ConfError(ValueError):
    """A report definition that can't be accepted."""


@dataclass(frozen=True)
class Key:
    """``kind``: field, rtag (request tag) or ttag (timer tag)."""

    kind: str
    name: str


@dataclass(frozen=True)
class Histogram:
    """Buckets of ``width_ns`` above ``low_ns``; ``high_ns`` follows from the truncated width."""

    low_ns: int
    width_ns: int
    buckets: int

    @property
    def high_ns(self) -> int:
        return self.low_ns + self.width_ns * self.buckets

    @property
    def least_id(self) -> int:
        return max(1, self.low_ns // self.width_ns)

    @property
    def most_id(self) -> int:
        return self.high_ns // self.width_ns

    @property
    def unit_magnitude(self) -> int:
        return self.least_id.bit_length() - 1

    def text(self) -> str:
        ms = lambda ns: ns // 1_000_000
        return f"hv={ms(self.low_ns)}:{ms(self.high_ns)}:{self.buckets}"


@dataclass(frozen=True)
class ReportConf:
    kind: str
    window_sec: int = 60
    tick_sec: int = 1
    keys: tuple[Key, ...] = ()
    histogram: Histogram | None = None
    percentiles: tuple[tuple[str, float], ...] = ()  # (column, percent)
    min_time: float = 0.0
    max_time: float = 0.0
    filters: tuple[tuple[Key, str], ...] = ()
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def bound_ns(self, which: str, unit: str = "s") -> int:
        v = self.min_time if which == "min" else self.max_time
        return int(v * NS) if unit == "s" else int(v * NS / 1000)

    @property
    def tick_count(self) -> int:
        return self.window_sec // self.tick_sec


def _whole(text: str, what: str) -> int:
    if not re.fullmatch(r"\d+", text) or int(text) == 0:
        raise ConfError(f"{what}: a positive number of seconds is needed, not {text!r}")
    return int(text)


def parse_window(text: str, default_sec: int = 60) -> tuple[int, int]:
    """(window, tick) in seconds of ``default_history_time``, ``<sec>`` or ``<sec>,<tick>``."""
    if text == "default_history_time":
        return default_sec, 1
    parts = text.split(",")
    if len(parts) > 2:
        raise ConfError(f"window: {text!r}")
    window = _whole(parts[0], "window")
    tick = _whole(parts[1], "tick") if len(parts) == 2 else 1
    if window % tick:
        raise ConfError(f"tick {tick} doesn't divide window {window}")
    return window, tick


def parse_key(text: str) -> Key:
    mark, name = (text[0], text[1:]) if text[0] in "~+@" else ("@", text)
    if not name:
        raise ConfError(f"key without a name: {text!r}")
    if mark == "~" and name not in FIELDS:
        raise ConfError(f"unknown request field {name!r}")
    return Key({"~": "field", "+": "rtag", "@": "ttag"}[mark], name)


def parse_keys(text: str) -> tuple[Key, ...]:
    if text == "no_keys":
        return ()
    keys = tuple(parse_key(k) for k in text.split(",") if k)
    if len(keys) > MAX_KEYS:
        raise ConfError(f"{len(keys)} keys; {MAX_KEYS} are allowed")
    return keys


def make_histogram(low_ms: int, high_ms: int, buckets: int) -> Histogram:
    if high_ms <= low_ms:
        raise ConfError("histogram: the upper bound must be above the lower one")
    if buckets <= 0:
        raise ConfError("histogram: at least one bucket is needed")
    if buckets > MAX_BUCKETS:
        raise ConfError(f"histogram: more than {MAX_BUCKETS} buckets")
    width = (high_ms - low_ms) * 1_000_000 // buckets
    if width == 0:
        raise ConfError("histogram: a bucket must be a nanosecond wide at least")
    h = Histogram(low_ms * 1_000_000, width, buckets)
    if 2 * h.least_id > h.most_id:
        raise ConfError(f"histogram: low {h.least_id} times 2 is above high {h.most_id}")
    return h


def parse_histogram(text: str) -> tuple[Histogram | None, tuple[tuple[str, float], ...]]:
    if text == "no_percentiles":
        return None, ()
    hist, wanted = None, []
    for token in (t for t in text.split(",") if t):
        if token.startswith("hv="):
            parts = token[3:].split(":")
            if len(parts) != 3 or not all(re.fullmatch(r"\d+", p) for p in parts):
                raise ConfError(f"histogram: hv=<low ms>:<high ms>:<buckets> expected, not {token!r}")
            hist = make_histogram(*map(int, parts))
        elif token.startswith("percentiles="):
            wanted += token.split("=", 1)[1].split(":")
        elif token.startswith("p"):
            wanted.append(token[1:])
        else:
            raise ConfError(f"histogram: unknown token {token!r}")
    if hist is None:
        raise ConfError("histogram: hv= is missing")
    if not wanted:
        raise ConfError("histogram: no percentile given")
    out = []
    for w in wanted:
        try:
            p = float(w)
        except ValueError:
            raise ConfError(f"percentile {w!r}") from None
        if not math.isfinite(p) or not 0 <= p <= 100:
            raise ConfError(f"percentile {w!r}")
        out.append((f"p{w}".replace(".", "_"), p))
    return hist, tuple(out)


def parse_filters(text: str) -> tuple[float, float, tuple[tuple[Key, str], ...]]:
    low = high = 0.0
    out = []
    if text != "no_filters":
        for item in (i for i in text.split(",") if i):
            if item.count("=") != 1:
                raise ConfError(f"filter: exactly one '=' expected in {item!r}")
            name, value = item.split("=")
            if name in ("min_time", "max_time"):
                try:
                    number = float(value)
                except ValueError:
                    raise ConfError(f"filter: {item!r}") from None
                low, high = (number, high) if name == "min_time" else (low, number)
            else:
                out.append((parse_key(name), value))
    if low < 0 or high < 0:
        raise ConfError("filter: negative time")
    if high and low > high:
        raise ConfError("filter: min_time above max_time")
    return low, high, tuple(out)


def parse_report_conf(text: str, default_window_sec: int = 60) -> ReportConf:
    """Parse and check a definition; every error is raised here, none later."""
    parts = text.strip().split("/")
    if parts[0] != "v2":
        raise ConfError("a definition starts with v2/")
    kind = KINDS.get(parts[1] if len(parts) > 1 else "")
    if kind is None:
        raise ConfError(f"unknown report kind in {text!r}")
    if kind in ("active", "stats"):
        if len(parts) != 2:
            raise ConfError(f"v2/{kind} has no further parts")
        return ReportConf(kind)
    if len(parts) != 6:
        raise ConfError(f"{len(parts)} parts; v2/<kind>/<window>/<keys>/<histogram>/<filters> expected")
    window, tick = parse_window(parts[2], default_window_sec)
    keys = parse_keys(parts[3])
    hist, pcts = parse_histogram(parts[4])
    low, high, filters = parse_filters(parts[5])
    warnings = []
    if kind == "packet" and keys:
        raise ConfError("a packet report has no keys")
    if kind != "packet" and not keys:
        raise ConfError(f"a {kind} report needs a key")
    if kind == "request" and any(k.kind == "ttag" for k in keys):
        raise ConfError("a request report has no timer tag keys")
    if kind != "timer" and any(k.kind == "ttag" for k, _ in filters):
        raise ConfError("timer tag filters belong to timer reports")
    if kind == "timer" and not any(k.kind == "ttag" for k in keys):
        warnings.append("a timer report without timer tags counts every timer")
    return ReportConf(kind, window, tick, keys, hist, pcts, low, high, filters, tuple(warnings))


# --- legacy definitions ---------------------------------------------------------------------

#: Keys of the numbered legacy reports (fixed values).
LEGACY_REPORTS = {
    "report1": ("script",), "report2": ("server",), "report3": ("host",), "report4": ("server", "script"), "report5": ("host", "script"), "report6": ("host", "server"),
    "report7": ("host", "server", "script"), "report8": ("status",), "report9": ("script", "status"), "report10": ("server", "status"), "report11": ("host", "status"),
    "report12": ("host", "script", "status"), "report13": ("schema",), "report14": ("script", "schema"), "report15": ("server", "schema"), "report16": ("host", "schema"),
    "report17": ("host", "script", "schema"), "report18": ("host", "status", "schema"),
}
LEGACY_BUCKETS, LEGACY_MAX_SEC = 32768, "60"
_BASE = {"info": (), "report": ("script",), "report2": ("script", "host", "server")}


def legacy_report_conf(comment: str) -> str | None:
    """The v2 definition of a legacy comment ``name[:tags[:filters[:percentiles]]]``; None where nothing corresponds."""
    name, tags, filters, pcts = (comment.split(":") + ["", "", ""])[:4]
    m = re.fullmatch(r"(r?tag)(2|N)?_(info|report2?)", name)
    if name in LEGACY_REPORTS:
        kind, keys = "request", [f"~{k}" for k in LEGACY_REPORTS[name]]
    elif m and m[1] == "tag":
        kind, keys = "timer", [f"~{k}" for k in _BASE[m[3]]] + [f"@{t}" for t in tags.split(",") if t]
    elif m and m[3] != "report2":
        kind, keys = "request", (["~host"] if m[3] == "report" else []) + [f"+{t}" for t in tags.split(",") if t]
    elif name == "tag":
        return None
    else:
        raise ConfError(f"unknown legacy report {name!r}")
    most, kept = LEGACY_MAX_SEC, []
    for f in (f for f in filters.split(",") if f):
        key, _, value = f.partition("=")
        if key == "histogram_max_time":
            most = value
        else:
            kept.append(f"{key}={value.replace('tag.', '+')}")
    wanted = ["50"] + [p for p in pcts.split(",") if p]
    hist = f"hv=0:{int(float(most) * 1000)}:{LEGACY_BUCKETS}," + ",".join(f"p{p}" for p in wanted)
    return f"v2/{kind}/default_history_time/{','.join(keys) or 'no_keys'}/{hist}/{','.join(kept) or 'no_filters'}"


TEMPLATES = {
    "report_by_host_name": "v2/request/default_history_time/~host/no_percentiles/no_filters",
    "report_by_script_name": "v2/request/default_history_time/~script/no_percentiles/no_filters",
    "report_by_server_name": "v2/request/default_history_time/~server/no_percentiles/no_filters",
    "info": "v2/packet/default_history_time/no_keys/no_percentiles/no_filters",
    "active": "v2/active",
    "stats": "v2/stats",
}
