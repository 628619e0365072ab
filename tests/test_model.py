"""Randomized lines: Spark parse vs a plain-Python model of the same rules.

The model uses Python ``re`` (Unicode classes, '.' stops at '\\n') with the
format grammar, tried in order, first match wins, and Python ``datetime`` for
timestamps (rollback year, 1-6 fraction digits for ISO, offsets to UTC). It
checks the Spark machinery: alternation + field layout, fused level format,
ASCII/Unicode routing, integer timestamp arithmetic, window, error words.
"""

import random
import re
from datetime import datetime, timedelta

from log_helpers import make_lines
from logarbor.functions.formats import CATALOG, MONTHS
from logarbor.operators.parse import parse
from logarbor.options import AnalyzerOptions

AS_OF = datetime(2024, 12, 31, 12, 0, 0)
DAYS = 365
OPTS = AnalyzerOptions(as_of=AS_OF, max_days=DAYS)
PY_PATTERNS = [(f.name, f.family, re.compile("^" + f.build(lambda n, rx: f"(?P<{n}>{rx})"))) for f in CATALOG]
ERROR_RE = re.compile(r"\b(error|failed|failure|exception|critical|panic)\b", re.IGNORECASE)


def model(line: str):
    line = line.strip()
    if len(line) < 15:
        return None
    if line[:3] in MONTHS:
        fam = "bsd"
    elif re.match(r"^\d{4}-\d{2}-\d{2}", line):
        fam = "iso"
    else:
        return None
    for name, family, rx in PY_PATTERNS:
        if family != fam:
            continue
        m = rx.match(line)
        if not m:
            continue
        g = {k: (v or "") for k, v in m.groupdict().items()}
        ts = bsd_ts(g) if fam == "bsd" else iso_ts(g)
        if ts is None or ts < AS_OF - timedelta(days=DAYS) or ts > AS_OF + timedelta(days=1):
            return None
        level = g.get("level") or None
        msg = g["msg"].strip()
        err = bool(level and level.upper() in ("ERROR", "CRITICAL", "FATAL")) or bool(ERROR_RE.search(msg))
        return (ts, g["svc"].strip(), msg, level, g["host"] or None, g.get("pid") or None, name, err)
    return None


def _clock(c):
    return int(c[0:2]), int(c[3:5]), int(c[6:8])


def bsd_ts(g):
    hh, mi, ss = _clock(g["clock"])
    micro = int(g.get("frac", "")[:6].ljust(6, "0")) if g.get("frac") else 0
    month = MONTHS.index(g["mon"]) + 1
    for year in (AS_OF.year, AS_OF.year - 1):
        try:
            t = datetime(year, month, int(g["day"]), hh, mi, ss, micro)
        except ValueError:
            continue
        if year == AS_OF.year and t > AS_OF:
            continue
        return t
    return None


def iso_ts(g):
    frac, offset = g.get("frac", ""), g.get("off", "") or g.get("boff", "")
    if g.get("tail"):
        m = re.match(r"^(\d{1,6})([+-]\d{2}:?\d{2})?$", g["tail"])
        if not m:
            return None
        frac, offset = m.group(1), m.group(2) or ""
    if len(frac) > 6 or (g.get("z") and g.get("boff")):
        return None
    y, mo, d = int(g["date"][0:4]), int(g["date"][5:7]), int(g["date"][8:10])
    hh, mi, ss = _clock(g["clock"])
    try:
        t = datetime(y, mo, d, hh, mi, ss, int(frac.ljust(6, "0")) if frac else 0)
    except ValueError:
        return None
    if offset:
        digits = offset.replace(":", "")
        oh, om = int(digits[1:3]), int(digits[3:5])
        if oh >= 24 or om >= 60:
            return None
        sign = -1 if offset[0] == "-" else 1
        t -= sign * timedelta(hours=oh, minutes=om)
    return t


HOSTS = ["web1", "db-2.local", "hé1", "node_7", "x"]
SERVICES = ["sshd", "cron", "kernel", "shop/pay", "web.ui", "my(app)", "a-b"]
WORDS = ["error", "Errors", "failed", "ok", "panic!", "FAILURE", "exceptional", "critical", "done", "ünïcode",
         "[WARN]", "[ERROR]", "x", "CRITICAL"]
SPACES = [" ", "  ", "\t", " ", "\x1c"]


def random_line(r: random.Random) -> str:
    sp = lambda: r.choice(SPACES) if r.random() < 0.15 else " "
    msg = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 6)))
    if r.random() < 0.15:
        msg = "[" + r.choice(["ERROR", "WARN", "INFO", "Crit"]) + "]" + r.choice(["", " "]) + msg
    clock = f"{r.choice([0, 9, 13, 23, 24]):02d}:{r.choice([0, 30, 59, 60]):02d}:{r.choice([0, 15, 59, 60]):02d}"
    frac = r.choice(["", "", ".5", ".123456", ".1234567", ".000000"])
    host, svc = r.choice(HOSTS), r.choice(SERVICES)
    pid = r.choice(["", f"[{r.randint(1, 99999)}]"])
    kind = r.random()
    if kind < 0.55:
        mon = r.choice(MONTHS + ("Foo",)) if r.random() < 0.95 else "jan"
        day = r.choice([1, 5, 9, 15, 28, 29, 30, 31, 32])
        return f"{mon}{sp()}{day:2d}{sp()}{clock}{frac}{sp()}{host}{sp()}{svc}{pid}:{r.choice(['', ' '])}{msg}"
    date = f"{r.choice([2023, 2024, 2024, 2024])}-{r.choice([1, 2, 12]):02d}-{r.choice([1, 15, 29, 30, 31]):02d}"
    if kind < 0.75:
        z = r.choice(["", "Z"])
        boff = r.choice(["", "", f" {r.choice('+-')}0{r.randint(0, 9)}00"])
        return f"{date}{r.choice(['T', ' '])}{clock}{frac}{z}{boff}{sp()}{host}{sp()}{svc}{pid}:{sp()}{msg}"
    if kind < 0.85:
        return f"{date}T{clock}+0{r.randint(0, 9)}00 {host} {r.choice(['kubelet', 'a.b'])}{pid or '[1]'}: {msg}"
    if kind < 0.95:
        off = r.choice(["+01:00", "-0530", "Z", "", "+25:00", ":30"])
        colon = r.choice([":", ""])
        return f"{date}T{clock}.{r.randint(1, 9999999)}{off} {host} {svc}{pid}{colon} {msg}"
    return r.choice(["junk line that is long enough", "Jan", "", "   Jan  5 10:00:00 h s: padded   "])


def test_random_lines_match_model(spark):
    r = random.Random(7)
    lines = [random_line(r) for _ in range(3000)]
    got = {row.line_seq: (row.timestamp, row.service, row.message, row.level, row.host, row.pid, row.format,
                          row.is_error)
           for row in parse(make_lines(spark, lines), OPTS).collect()}
    want = {i: m for i, line in enumerate(lines) if (m := model(line)) is not None}
    assert len(want) > 600
    diff = [(i, lines[i], got.get(i), want.get(i)) for i in set(got) | set(want) if got.get(i) != want.get(i)]
    assert not diff, diff[:5]
