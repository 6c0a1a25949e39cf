"""Text-field parsers of the accounting dump, as Column expressions.

Each parser is total: malformed text gives the documented default (0, null or
the empty array) instead of an error, so one bad line never fails a task.
Every cast is gated by a shape test first, because Spark's casts accept more
than the formats being reproduced (for instance ``'1D'`` as a double or
``'2025-8-1'`` as a date).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobacct.schemas import NO_VALUE_TEXTS, UNFINISHED_RAW_STATES

# Whitespace characters removed by strip_ws (those of str.strip() for ASCII).
WS = " \t\n\r\x0b\x0c"

# The gates below avoid regular expressions on the hot path: a character-set
# test (translate) plus a try_cast is enough, and cheaper per row.


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (not only spaces)."""
    return F.trim(_c(c), F.lit(WS))


def only_chars(c: Column, chars: str) -> Column:
    """True when ``c`` is non-empty and made only of ``chars``."""
    return (F.length(c) > 0) & (F.translate(c, chars, "") == "")


def to_float(c: Column | str) -> Column:
    """Double value of a decimal text, null when the text is not a number.

    Spark's cast also takes 'Infinity', 'NaN' and a 'd' / 'f' suffix; those are
    excluded by allowing digits, sign, point and exponent characters only."""
    t = strip_ws(c)
    return F.when(only_chars(t, "0123456789+-.eE"), t.try_cast("double"))


def is_digits(c: Column) -> Column:
    """What str.isdigit() accepts for ASCII text."""
    return only_chars(c, "0123456789")


def to_int(txt: Column | str) -> Column:
    """Integer value of a text the way int() reads it (optional sign,
    surrounding blanks); null otherwise."""
    t = strip_ws(txt)
    body = F.when(t.startswith("+") | t.startswith("-"), t.substr(F.lit(2), F.length(t))).otherwise(t)
    return F.when(is_digits(body), t.try_cast("bigint"))


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


# --- step classification (P1-P3) -------------------------------------------
def job_id_base(job_id: Column | str) -> Column:
    """Text before the first '.' ('123.batch' -> '123', '123_4' -> '123_4')."""
    return F.substring_index(_c(job_id), ".", 1)


def is_batch_step(job_id: Column | str) -> Column:
    return _c(job_id).contains(".batch")


def is_main_job(job_id: Column | str) -> Column:
    return ~_c(job_id).contains(".")


def is_finished(state: Column | str) -> Column:
    """False while the raw (un-normalised) state can still change."""
    return ~_c(state).isin(*UNFINISHED_RAW_STATES)


# --- dates and states (P4-P6) ----------------------------------------------
def _date_part(t: Column) -> Column:
    part = F.when(t.contains("T"), F.substring_index(t, "T", 1)).otherwise(F.substring(t, 1, 10))
    ok = t.isNotNull() & ~t.isin(*NO_VALUE_TEXTS) & (F.length(part) == 10) & (count_char(part, "-") == 2)
    return F.when(ok, part)


def job_date(start: Column | str, submit: Column | str) -> Column:
    """The job's own date as 'yyyy-MM-dd' text: from Start, else from Submit.

    Only the shape is checked (10 characters, two '-'), not the calendar."""
    return F.coalesce(_date_part(_c(start)), _date_part(_c(submit)))


def normalize_state(state: Column | str) -> Column:
    """'CANCELLED by 123' and other CANCELLED variants -> 'CANCELLED'."""
    s = _c(state)
    return F.when(s.startswith("CANCELLED"), F.lit("CANCELLED")).otherwise(s)


def user_or_uid(user: Column | str, uid: Column | str) -> Column:
    """Blank user -> 'uid_<UID>'; blank UID as well -> 'MISSING_USER'."""
    u, i = _c(user), _c(uid)
    blank_u = u.isNull() | (strip_ws(u) == "")
    blank_i = i.isNull() | (strip_ws(i) == "")
    return (
        F.when(~blank_u, u)
        .when(~blank_i, F.concat(F.lit("uid_"), i))
        .otherwise(F.lit("MISSING_USER"))
    )


# --- quantities (P7-P11, P13, P14) -----------------------------------------
def memory_mb(mem: Column | str) -> Column:
    """Memory text -> MB. K /1024, M x1, G x1024, T x1024^2, bare number is KB.

    A trailing per-node 'n' / per-CPU 'c' is dropped (not multiplied). Only
    upper-case suffixes count; anything else is 0."""
    m = _c(mem)
    s = F.rtrim(strip_ws(m), F.lit("nc"))
    body = s.substr(F.lit(1), F.length(s) - 1)
    num = to_float(body)
    bare = F.when(only_chars(s, "0123456789."), s.try_cast("double"))
    value = (
        F.when(s.endswith("K"), num / 1024)
        .when(s.endswith("M"), num)
        .when(s.endswith("G"), num * 1024)
        .when(s.endswith("T"), num * 1024 * 1024)
        .otherwise(bare / 1024)
    )
    empty = m.isNull() | m.isin("", "N/A", "0")
    return F.when(empty, F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def cpu_seconds(text: Column | str) -> Column:
    """'[D-][H:]M:S[.fff]' -> seconds. Sub-seconds are dropped.

    No colon: only the days part counts. More than one '-': 0. Valid days with
    a bad clock part keep the days."""
    t = _c(text)
    s = F.substring_index(t, ".", 1)
    dashes = count_char(s, "-")
    days = to_float(F.substring_index(s, "-", 1))
    clock_txt = F.when(dashes >= 1, F.substring_index(s, "-", -1)).otherwise(s)
    parts = F.split(clock_txt, ":", -1)
    n = F.size(parts)
    p0, p1, p2 = (to_float(F.get(parts, i)) for i in range(3))
    clock = F.coalesce(
        F.when(~clock_txt.contains(":"), F.lit(0.0))
        .when(n == 3, p0 * 3600 + p1 * 60 + p2)
        .when(n == 2, p0 * 60 + p1)
        .otherwise(F.lit(0.0)),
        F.lit(0.0),
    )
    bad = t.isNull() | t.isin("", "INVALID", "UNLIMITED") | (dashes > 1) | ((dashes == 1) & days.isNull())
    return F.when(bad, F.lit(0.0)).otherwise(F.when(dashes == 1, days * 86400).otherwise(F.lit(0.0)) + clock)


def safe_int(text: Column | str) -> Column:
    """All-digit text -> bigint, anything else (negatives too) -> 0."""
    t = _c(text)
    return F.coalesce(F.when(is_digits(t), t.try_cast("bigint")), F.lit(0).cast("bigint"))


def safe_timestamp(text: Column | str) -> Column:
    """ISO text -> timestamp; naive text is read as UTC (session zone must be
    UTC), an explicit offset is kept as an instant. Placeholders and
    malformed text -> null."""
    t = _c(text)
    head = F.substring(t, 1, 10)
    shape = (F.translate(head, "0123456789", "dddddddddd") == "dddd-dd-dd")
    ok = t.isNotNull() & ~t.isin(*NO_VALUE_TEXTS) & shape
    return F.when(ok, F.try_to_timestamp(t))


def gpu_count(alloc_tres: Column | str) -> Column:
    """GPUs of an AllocTRES list: the first item holding 'gres/gpu=', value
    after its first '=' if all digits, else 0. Typed 'gres/gpu:a100=2' items
    are not counted."""
    a = _c(alloc_tres)
    item = F.get(F.filter(F.split(a, ",", -1), lambda x: x.contains("gres/gpu=")), 0)
    val = F.split_part(item, F.lit("="), F.lit(2))
    return F.coalesce(F.when(is_digits(val), val.try_cast("bigint")), F.lit(0).cast("bigint"))


def partition_cores(partition: Column | str) -> Column:
    """First digit run of a partition name as cores, else 0."""
    d = F.regexp_extract(_c(partition), r"([0-9]+)", 1)
    return F.coalesce(d.try_cast("bigint"), F.lit(0).cast("bigint"))


def gres_gpus(gres: Column | str) -> Column:
    """GPU count of a GRES text ('gpu:4', 'gpu:v100:8(S:0-1)'); null when the
    text names no GPU or its last ':' piece is not a number."""
    g = _c(gres)
    last = F.element_at(F.split(F.regexp_replace(g, r"\(S:[0-9-]+\)", ""), ":", -1), -1)
    return F.when(g.contains("gpu:") & is_digits(last), last.try_cast("bigint"))


# --- texts packed into one -------------------------------------------------
def packed(*texts: Column) -> Column:
    """The texts joined by '|', a fraction of the size of as many columns when shuffled;
    null where that could not be taken apart again (a null text, a '|' in a text)."""
    line = F.concat(*[x for t in texts for x in (F.lit("|"), t)][1:])
    bars = F.octet_length(line) - F.octet_length(F.replace(line, F.lit("|"), F.lit("")))
    return F.when(bars == len(texts) - 1, line)


def unpacked(line: Column) -> Column:
    """The texts of ``packed`` as an array."""
    return F.split(line, r"\|", -1)
