"""Catalog of the accepted log-line formats and the one-pass matcher built from it.

Each format is written once, from a small token grammar, with named groups.
Formats of one family (those whose lines start with a month name, and those
that start with an ISO date) are joined into a single alternation, so a line is
scanned by exactly one regex and the first format that matches wins, as in a
list of patterns tried in order.

The alternation is applied with ``regexp_replace``, whose replacement lays the
captured groups out as ``\\n``-separated fields (a group that did not take part
yields an empty string). No field can hold a ``\\n``: messages use ``.`` under
UNIX_LINES, all other groups use narrow classes. Each format writes its message
into a field of its own; the first non-empty one names the format that matched.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from logarbor.functions.text import NON_WS_CLASS, WS_CLASS

# Month names accepted by the line pre-check and by %b.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Token grammar of the line formats (Python `re` semantics,
# reproduced for Java with (?U) Unicode classes and (?d) so '.' stops only at \n).
WS = WS_CLASS
NONWS = NON_WS_CLASS
MON = r"\w{3}"
DAY = r"\d{1,2}"
CLOCK = r"\d{2}:\d{2}:\d{2}"
DIGITS = r"\d+"
DATE = r"\d{4}-\d{2}-\d{2}"
HOST = r"[\w\-.]+"
SVC = r"[\w\-./]+"
WORD_SVC = r"\w+"
LEVEL_UPPER = r"[A-Z]+"
LEVEL_WORD = r"\w+"
OFFSET_HHMM = r"[+-]\d{4}"
OFFSET_PLUS_HHMM = r"\+\d{4}"
OFFSET_TAIL = r"[\d+,\-./:]+"  # digits and the code points '+' through ':'
MSG = r".+"
DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
FLAGS = "(?dU)"
# For pure-ASCII lines Unicode and ASCII classes agree, and ASCII classes are cheaper.
ASCII_FLAGS = "(?d)"

# Canonical field layout shared by all formats (message fields come last).
FIELDS = ("mon", "day", "date", "clock", "frac", "z", "off", "boff", "tail", "host", "svc", "pid", "level")

Group = Callable[[str, str], str]


def _bsd_head(g: Group, frac: bool) -> str:
    head = g("mon", MON) + WS + "+" + g("day", DAY) + WS + "+" + g("clock", CLOCK)
    if frac:
        head += r"(?:\." + g("frac", DIGITS) + ")?"
    return head + WS + "+" + g("host", HOST) + WS + "+" + g("svc", SVC)


def _with_level(g: Group) -> str:
    # a traditional line whose message starts with an upper-case [LEVEL] token
    return (_bsd_head(g, frac=True) + r"(?:\[" + g("pid", DIGITS) + r"\])?:" + WS + "*"
            + r"\[" + g("level", LEVEL_UPPER) + r"\]" + WS + "*" + g("msg", MSG) + "$")


def _traditional(g: Group) -> str:
    return (_bsd_head(g, frac=True) + r"(?:\[" + g("pid", DIGITS) + r"\])?:" + WS + "*"
            + g("msg", MSG) + "$")


def _traditional_or_level(g: Group) -> str:
    # with_level tried before traditional, as one alternative: the optional [LEVEL]
    # token is taken when the rest still matches, else the line is plain traditional
    return (_bsd_head(g, frac=True) + r"(?:\[" + g("pid", DIGITS) + r"\])?:" + WS + "*"
            + r"(?:\[" + g("level", LEVEL_UPPER) + r"\]" + WS + "*)?" + g("msg", MSG) + "$")


def _traditional_simple(g: Group) -> str:
    return _bsd_head(g, frac=False) + ":" + WS + "*" + g("msg", MSG) + "$"


def _iso8601(g: Group) -> str:
    return (g("date", DATE) + "[T ]" + g("clock", CLOCK) + r"(?:\." + g("frac", DIGITS) + ")?"
            + g("z", "Z") + "?" + "(?:" + WS + "+" + g("boff", OFFSET_HHMM) + ")?"
            + WS + "+" + g("host", HOST) + WS + "+" + g("svc", SVC)
            + r"(?:\[" + g("pid", DIGITS) + r"\])?:" + WS + "*" + g("msg", MSG) + "$")


def _journald(g: Group) -> str:
    return (g("date", DATE) + "T" + g("clock", CLOCK) + g("off", OFFSET_PLUS_HHMM)
            + WS + "+" + g("host", HOST) + WS + "+" + g("svc", WORD_SVC)
            + r"\[" + g("pid", DIGITS) + r"\]:" + WS + "*" + g("msg", MSG) + "$")


def _rainerscript_enhanced(g: Group) -> str:
    return (g("date", DATE) + "T" + g("clock", CLOCK) + r"\." + g("tail", r"\d" + OFFSET_TAIL)
            + WS + "+" + g("host", NONWS + "+") + WS + "+" + g("svc", NONWS + "+?")
            + r"(?:\[" + g("pid", DIGITS) + r"\])?:?" + WS + "+"
            + r"(?:\[" + g("level", LEVEL_WORD) + r"\]" + WS + "+)?" + g("msg", MSG) + "$")


@dataclass(frozen=True)
class LineFormat:
    name: str
    family: str  # "bsd": month-name prefix, year inferred; "iso": full date
    build: Callable[[Group], str]
    description: str


CATALOG = (
    LineFormat("with_level", "bsd", _with_level, "month, day, clock; [LEVEL] before the message"),
    LineFormat("traditional", "bsd", _traditional, "month, day, clock; optional fraction and pid"),
    LineFormat("traditional_simple", "bsd", _traditional_simple, "month, day, clock; no fraction, no pid"),
    LineFormat("iso8601", "iso", _iso8601, "ISO date and clock; optional Z or offset"),
    LineFormat("journald", "iso", _journald, "ISO date with a + offset; pid required"),
    LineFormat("rainerscript_enhanced", "iso", _rainerscript_enhanced, "ISO date with fraction and offset; optional [LEVEL]"),
)
BY_NAME = {f.name: f for f in CATALOG}


def standalone_regex(name: str) -> str:
    """One format as a plain anchored regex with index groups (tests, reports)."""
    return FLAGS + "^" + BY_NAME[name].build(lambda _n, rx: "(" + rx + ")")


@dataclass(frozen=True)
class FamilyMatcher:
    family: str
    labels: tuple[tuple[str, ...], ...]  # per message field: (name,) or (name if level, name otherwise)
    pattern: str
    replacement: str

    @property
    def ascii_pattern(self) -> str:
        return ASCII_FLAGS + self.pattern[len(FLAGS):]

    @property
    def formats(self) -> tuple[str, ...]:
        return tuple(n for lab in self.labels for n in lab)

    @property
    def n_fields(self) -> int:
        return len(FIELDS) + len(self.labels)


def family_matcher(family: str, formats: tuple[str, ...]) -> FamilyMatcher | None:
    """Alternation of the active formats of one family, with its field layout.

    When both ``with_level`` and ``traditional`` are active they become one
    alternative (same head, optional level token): one scan instead of two.
    """
    active = [f for f in CATALOG if f.family == family and f.name in formats]
    if not active:
        return None
    names = [f.name for f in active]
    alternatives: list[tuple[Callable[[Group], str], tuple[str, ...]]] = []
    for fmt in active:
        if fmt.name == "with_level" and "traditional" in names:
            alternatives.append((_traditional_or_level, ("with_level", "traditional")))
        elif fmt.name == "traditional" and "with_level" in names:
            continue
        else:
            alternatives.append((fmt.build, (fmt.name,)))
    used: dict[str, list[str]] = {name: [] for name in FIELDS + ("msg",)}
    bodies = []
    for i, (build, _labels) in enumerate(alternatives):
        def g(name: str, rx: str, _i: int = i) -> str:
            used[name].append(f"{name}{_i}")
            return f"(?<{name}{_i}>{rx})"
        bodies.append(build(g))
    pattern = FLAGS + "^(?:" + "|".join(bodies) + ")"
    fields = ["".join("${" + ref + "}" for ref in used[name]) for name in FIELDS]
    fields += ["${" + ref + "}" for ref in used["msg"]]
    replacement = "\n" + "\n".join(fields)
    return FamilyMatcher(family, tuple(lab for _b, lab in alternatives), pattern, replacement)
