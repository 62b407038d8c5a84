"""Dates, datetimes, times of day and durations.

A date is DATE, a datetime TIMESTAMP_NTZ, a datetimezone TIMESTAMP (the instant;
its offset is not kept), a time the day-time interval since midnight in a struct,
a duration a day-time interval.
"""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlode.functions.kit import Kit, time_of

from mlode.plans.errors import EvalError, UnsupportedError
from mlode.plans.values import DATE, DATETIME, DATETIMEZONE, DURATION, LOGICAL, NUMBER, TEXT, TIME, Col, Enum, Kind, Rec, as_col, time_value

ISO_DATE = r"^\d{4}-?\d{2}-?\d{2}$"
ISO_TIME = r"\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,9})?)?)?"
ISO_OFFSET = r"(Z|[+-]\d{2}(:?\d{2})?)"
EPOCH = dt.date(1899, 12, 30)
MICROS = 86_400_000_000
#: fixed values: format letters
DATE_TOKENS = ("yyyy", "yy", "MMMM", "MMM", "MM", "M", "dddd", "ddd", "dd", "d")
TIME_TOKENS = ("HH", "H", "hh", "h", "mm", "m", "ss", "s", "fff", "tt")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def interval_micros(c: Column) -> Column:
    """Whole microseconds of a day-time interval."""
    return (c.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def micros_interval(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))


def two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def ntz_time(c: Column) -> Column:
    """The interval since midnight of a datetime."""
    return c - F.date_trunc("DAY", c).cast("timestamp_ntz")


def parse_date(t: Column) -> tuple[Column, Column]:
    t = F.trim(t)
    got = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t), F.lit("yyyy-MM-dd"))
    flat = F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd"))
    value = F.coalesce(got, flat).cast("date")
    return value.isNotNull(), value


def parse_datetime(t: Column) -> tuple[Column, Column]:
    """An ISO datetime; an offset is dropped, the wall clock stays."""
    t = F.trim(t)
    fits = t.rlike(rf"^\d{{4}}-?\d{{2}}-?\d{{2}}([T ]{ISO_TIME}{ISO_OFFSET}?)?$")
    bare = F.regexp_replace(t, ISO_OFFSET + "$", "")
    bare = F.when(t.rlike(rf"[T ]{ISO_TIME}{ISO_OFFSET}$"), bare).otherwise(t)
    value = F.when(fits, bare).try_cast("timestamp_ntz")
    return value.isNotNull(), value


def parse_zoned(t: Column) -> tuple[Column, Column]:
    t = F.trim(t)
    value = F.when(t.rlike(rf"^\d{{4}}-?\d{{2}}-?\d{{2}}[T ]{ISO_TIME}{ISO_OFFSET}$"), t).try_cast("timestamp")
    return value.isNotNull(), value


def parse_time(t: Column) -> tuple[Column, Column]:
    t = F.trim(t)
    parts = [F.regexp_extract(t, r"^T?(\d{2}):?(\d{2})?:?(\d{2}(?:[.,]\d{1,6})?)?$", k) for k in (1, 2, 3)]
    num = lambda p, kind: F.when(p != "", F.replace(p, F.lit(","), F.lit("."))).try_cast(kind)
    h, m, s = num(parts[0], "int"), F.coalesce(num(parts[1], "int"), F.lit(0)), F.coalesce(num(parts[2], "decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    ok = h.isNotNull() & (h < 24) & (m < 60) & (s < 60)
    return F.coalesce(ok, F.lit(False)), F.make_dt_interval(F.lit(0), h, m, s)


def parse_duration(t: Column) -> tuple[Column, Column]:
    t = F.trim(t)
    pattern = r"^(-?)(?:(\d+)\.)?(\d+):(\d+):(\d+(?:\.\d*)?)$"
    sign, d, h, m, s = (F.regexp_extract(t, pattern, k) for k in range(1, 6))
    num = lambda p: F.coalesce(F.when(p != "", p).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
    seconds = num(d) * 86400 + num(h) * 3600 + num(m) * 60 + num(s)
    value = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.when(sign == "-", -1).otherwise(1) * seconds).cast("decimal(18,6)"))
    return t.rlike(pattern), value


def from_serial(c: Column) -> Column:
    """The datetime of a day count."""
    return F.lit(EPOCH).cast("timestamp_ntz") + micros_interval(F.round(c.cast("double") * MICROS).cast("long"))


def register(kit: Kit) -> None:
    ev, add, fn = kit.ev, kit.add, kit.fn

    def checked(c: Column, parsed: tuple[Column, Column], name: str, what: str, kind: str) -> Column:
        ok, value = parsed
        return kit.fail(ok | c.isNull(), value, f"{name}: not a {what}", kind)

    def serial(c: Column, name: str) -> Column:
        day = F.floor(c.cast("double"))
        return kit.fail(~day.between(1, 60) | c.isNull(), from_serial(c), f"{name}: serials 1 to 60 are ambiguous", "timestamp_ntz")

    def culture(v: Any, name: str) -> None:
        v = ev.const(v, f"culture of {name}")
        if v not in (None, "", "en", "en-US", "en-us"):
            kit.refuse(f"culture {v!r} of {name}")

    def as_date(v: Any, name: str) -> Col | None:
        if v is None:
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "null":
            return None
        if k == "date":
            return c
        if k in ("datetime", "datetimezone"):
            return Col(c.c.cast("date"), DATE, c.free)
        if k in ("text", "any"):
            return Col(checked(c.c, parse_date(c.c), name, "date", "date"), DATE, c.free)
        if k == "number":
            return Col(serial(c.c, name).cast("date"), DATE, c.free)
        raise EvalError(f"{name}: a date is expected, not a {k}")

    def as_moment(v: Any, name: str) -> Col | None:
        """A date stays a date, all else becomes a datetime."""
        if v is None:
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "null":
            return None
        if k in ("date", "datetime", "datetimezone"):
            return c
        if k in ("text", "any"):
            if isinstance(v, str) and re.fullmatch(ISO_DATE, v.strip()):
                return as_date(v, name)
            return Col(checked(c.c, parse_datetime(c.c), name, "datetime", "timestamp_ntz"), DATETIME, c.free)
        if k == "number":
            return Col(serial(c.c, name), DATETIME, c.free)
        raise EvalError(f"{name}: a date or datetime is expected, not a {k}")

    def as_datetime(v: Any, name: str) -> Col | None:
        c = as_moment(v, name)
        return c if c is None or c.kind.name != "date" else Col(c.c.cast("timestamp_ntz"), DATETIME, c.free)

    def as_time(v: Any, name: str) -> Col | None:
        """The interval since midnight."""
        if v is None:
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "null":
            return None
        if k == "time":
            return Col(time_of(c.c), TIME, c.free)
        if k in ("datetime", "datetimezone"):
            return Col(ntz_time(c.c.cast("timestamp_ntz")), TIME, c.free)
        if k in ("text", "any"):
            ok, value = parse_time(c.c)
            ok2, moment = parse_datetime(c.c)
            return Col(checked(c.c, (ok | ok2, F.coalesce(F.when(ok, value), ntz_time(moment))), name, "time", "interval day to second"), TIME, c.free)
        if k == "number":
            x = c.c.cast("double")
            return Col(micros_interval(F.round((x - F.floor(x)) * MICROS).cast("long")), TIME, c.free)
        raise EvalError(f"{name}: a time is expected, not a {k}")

    def as_duration(v: Any, name: str) -> Col | None:
        if v is None:
            return None
        c = as_col(v)
        k = c.kind.name
        if k == "null":
            return None
        if k == "duration":
            return c
        if k == "number":
            return Col(micros_interval(F.round(c.c.cast("double") * MICROS).cast("long")), DURATION, c.free)
        if k in ("text", "any"):
            return Col(checked(c.c, parse_duration(c.c), name, "duration", "interval day to second"), DURATION, c.free)
        raise EvalError(f"{name}: a duration is expected, not a {k}")

    # -- literals
    def parts(args: tuple, name: str) -> list[Column]:
        cols = [as_col(a) for a in args]
        if any(c.kind.name not in ("number", "any") for c in cols):
            raise EvalError(f"{name} needs numbers")
        return [c.c for c in cols]

    def literal(name: str, count: int, plain: Any, made: Any, kind: Kind) -> None:
        def call(*args: Any) -> Any:
            if not any(isinstance(a, Col) for a in args):
                try:
                    return plain(*args)
                except (TypeError, ValueError, OverflowError) as e:
                    raise EvalError(f"{name}: {e}") from e
            return Col(made(*parts(args, name)), kind, all(as_col(a).free for a in args))

        fn(name, count, count, call)

    def seconds(s: float) -> dict[str, int]:
        return {"second": int(s), "microsecond": round((s - int(s)) * 1_000_000)}

    literal("#date", 3, lambda y, m, d: dt.date(y, m, d), lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")), DATE)
    literal("#datetime", 6, lambda y, m, d, h, n, s: dt.datetime(y, m, d, h, n, **seconds(s)), lambda y, m, d, h, n, s: F.make_timestamp_ntz(*[x.cast("int") for x in (y, m, d, h, n)], s.cast("decimal(16,6)")), DATETIME)
    literal("#time", 3, lambda h, m, s: dt.time(h, m, **seconds(s)), lambda h, m, s: time_value(F.make_dt_interval(F.lit(0), h.cast("int"), m.cast("int"), s.cast("decimal(18,6)"))), TIME)
    literal("#duration", 4, lambda d, h, m, s: dt.timedelta(days=d, hours=h, minutes=m, seconds=s), lambda d, h, m, s: F.make_dt_interval(d.cast("int"), h.cast("int"), m.cast("int"), s.cast("decimal(18,6)")), DURATION)

    def zoned(y: int, m: int, d: int, h: int, n: int, s: float, oh: int, om: int) -> dt.datetime:
        return dt.datetime(y, m, d, h, n, **seconds(s), tzinfo=dt.timezone(dt.timedelta(hours=oh, minutes=om)))

    def zoned_col(y, m, d, h, n, s, oh, om) -> Column:
        at = F.make_timestamp_ntz(*[x.cast("int") for x in (y, m, d, h, n)], s.cast("decimal(16,6)"))
        return to_instant(at, oh.cast("int") * 60 + om.cast("int"))

    literal("#datetimezone", 8, zoned, zoned_col, DATETIMEZONE)

    def to_instant(ntz: Column, offset_minutes: Column) -> Column:
        utc = ntz - F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))
        return F.to_timestamp(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))

    # -- accessors
    def of_date(name: str, made: Any, kind: Kind = NUMBER, whole: bool = True, most: int = 1) -> None:
        def call(*args: Any) -> Any:
            c = as_date(args[0], name)
            if c is None:
                return None
            return Col(made(c.c, *args[1:]), kind, c.free, whole)

        fn(name, 1, most, call)

    long = lambda f: lambda c: f(c).cast("long")
    of_date("Date.Year", long(F.year))
    of_date("Date.Month", long(F.month))
    of_date("Date.Day", long(F.dayofmonth))
    of_date("Date.DayOfYear", long(F.dayofyear))
    of_date("Date.QuarterOfYear", long(F.quarter))

    def first_day(v: Any, name: str) -> int:
        v = ev.const(v, f"first day of {name}")
        n = 0 if v is None else v.value if isinstance(v, Enum) else v
        if not isinstance(n, int) or not 0 <= n <= 6:
            raise EvalError(f"{name}: not a day")
        return n

    def weekday(c: Column, first: int) -> Column:
        return (F.dayofweek(c) - 1 - first + 7) % 7

    of_date("Date.DayOfWeek", lambda c, f=None: weekday(c, first_day(f, "Date.DayOfWeek")).cast("long"), most=2)

    def named(name: str, pattern: str) -> None:
        def made(c: Column, said: Any = None) -> Column:
            culture(said, name)
            return F.date_format(c, pattern)

        of_date(name, made, TEXT, False, 2)

    named("Date.DayOfWeekName", "EEEE")
    named("Date.MonthName", "MMMM")

    def week(c: Column, f: Any = None) -> Column:
        n = first_day(f, "Date.WeekOfYear")
        start = F.make_date(F.year(c), F.lit(1), F.lit(1))
        return (F.floor((F.datediff(c, start) + weekday(start, n)) / 7) + 1).cast("long")

    of_date("Date.WeekOfYear", week, most=2)
    of_date("Date.IsInCurrentMonth", lambda c: F.trunc(c, "month") == F.trunc(F.current_date(), "month"), LOGICAL, False)
    of_date("Date.IsInCurrentYear", lambda c: F.year(c) == F.year(F.current_date()), LOGICAL, False)

    def date_from(v: Any, said: Any = None) -> Any:
        culture(said, "Date.From")
        return as_date(v, "Date.From")

    fn("Date.From", 1, 2, date_from)

    # -- shifts that keep the kind
    def shifted(name: str, on_date: Any, on_moment: Any) -> None:
        def call(v: Any, n: Any) -> Any:
            c = as_moment(v, name)
            if c is None or n is None:
                return None
            k = as_col(n)
            if k.kind.name not in ("number", "any"):
                raise EvalError(f"{name} needs a number")
            return Col((on_date if c.kind.name == "date" else on_moment)(c.c, k.c), c.kind, c.free and k.free)

        fn(name, 2, 2, call)

    def days(c: Column, n: Column, times: int = 1) -> Column:
        return c + micros_interval(F.round(n.cast("double") * times * MICROS).cast("long"))

    shifted("Date.AddDays", lambda c, n: F.date_add(c, F.floor(n).cast("int")), days)
    shifted("Date.AddWeeks", lambda c, n: F.date_add(c, F.floor(n * 7).cast("int")), lambda c, n: days(c, n, 7))
    shifted("Date.AddMonths", lambda c, n: F.add_months(c, n.cast("int")), lambda c, n: c + F.make_ym_interval(F.lit(0), n.cast("int")))
    shifted("Date.AddYears", lambda c, n: F.add_months(c, n.cast("int") * 12), lambda c, n: c + F.make_ym_interval(n.cast("int"), F.lit(0)))

    def edge(name: str, made: Any, most: int = 1) -> None:
        def call(v: Any, *rest: Any) -> Any:
            c = as_moment(v, name)
            if c is None:
                return None
            d = made(c.c.cast("date"), *rest)
            return Col(d, DATE, c.free) if c.kind.name == "date" else Col(d.cast("timestamp_ntz"), DATETIME, c.free)

        fn(name, 1, most, call)

    edge("Date.StartOfMonth", lambda d: F.trunc(d, "month"))
    edge("Date.EndOfMonth", F.last_day)
    edge("Date.StartOfYear", lambda d: F.trunc(d, "year"))
    edge("Date.EndOfYear", lambda d: F.make_date(F.year(d), F.lit(12), F.lit(31)))
    edge("Date.StartOfWeek", lambda d, f=None: F.date_sub(d, weekday(d, first_day(f, "Date.StartOfWeek"))), 2)
    edge("Date.EndOfWeek", lambda d, f=None: F.date_add(F.date_sub(d, weekday(d, first_day(f, "Date.EndOfWeek"))), 6), 2)

    # -- text
    def formatted(name: str, date: Column | None, clock: Column | None, form: str) -> Column:
        """form with its letter runs replaced; clock: interval since midnight."""
        total = None if clock is None else interval_micros(clock)
        hour = F.lit(0) if total is None else (F.floor(total / 3_600_000_000)).cast("int")
        minute = F.lit(0) if total is None else (F.floor(total / 60_000_000) % 60).cast("int")
        second = F.lit(0) if total is None else (F.floor(total / 1_000_000) % 60).cast("int")
        micro = F.lit(0) if total is None else (total % 1_000_000).cast("int")
        half = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
        made = []
        for run, rest in re.findall(r"([A-Za-z]+)|([^A-Za-z]+)", form):
            if rest:
                made.append(F.lit(rest))
                continue
            if run in DATE_TOKENS:
                if date is None:
                    raise EvalError(f"{name}: {form!r} formats a date")
                plain = {"yyyy": lambda: F.lpad(F.year(date).cast("string"), 4, "0"), "yy": lambda: two(F.year(date) % 100), "M": lambda: F.month(date).cast("string"), "MM": lambda: two(F.month(date)), "d": lambda: F.dayofmonth(date).cast("string"), "dd": lambda: two(F.dayofmonth(date))}
                made.append(plain[run]() if run in plain else F.date_format(date, {"dddd": "EEEE", "ddd": "EEE"}.get(run, run)))
            elif run in TIME_TOKENS:
                plain = {"HH": lambda: two(hour), "H": lambda: hour.cast("string"), "hh": lambda: two(half), "h": lambda: half.cast("string"), "mm": lambda: two(minute), "m": lambda: minute.cast("string"), "ss": lambda: two(second), "s": lambda: second.cast("string"), "fff": lambda: F.lpad(F.floor(micro / 1000).cast("string"), 3, "0"), "tt": lambda: F.when(hour < 12, "AM").otherwise("PM")}
                made.append(plain[run]())
            else:
                raise UnsupportedError(f"{name}: the format letters {run!r}")
        return F.concat(*made) if made else F.lit("")

    def options(name: str, rest: tuple) -> str | None:
        form = ev.const(rest[0], f"format of {name}") if rest else None
        said = rest[1] if len(rest) > 1 else None
        if isinstance(form, Rec):
            if set(form) - {"Format", "Culture"}:
                kit.refuse(f"options {sorted(set(form) - {'Format', 'Culture'})} of {name}")
            form, said = form.get("Format"), said if said is not None else form.get("Culture")
        culture(said, name)
        if form is not None and not isinstance(form, str):
            raise EvalError(f"{name}: the format must be a text")
        return form

    def clock_text(total: Column) -> Column:
        base = F.concat_ws(":", two(F.floor(total / 3_600_000_000)), two(F.floor(total / 60_000_000) % 60), two(F.floor(total / 1_000_000) % 60))
        return F.when(total % 1_000_000 != 0, F.concat(base, F.lit("."), F.lpad((total % 1_000_000).cast("string"), 6, "0"))).otherwise(base)

    def date_text(v: Any, *rest: Any) -> Any:
        form = options("Date.ToText", rest)
        c = as_date(v, "Date.ToText")
        if c is None:
            return None
        return Col(formatted("Date.ToText", c.c, None, form if form is not None else "yyyy-MM-dd"), TEXT, c.free)

    def moment_text(v: Any, *rest: Any) -> Any:
        form = options("DateTime.ToText", rest)
        c = as_datetime(v, "DateTime.ToText")
        if c is None:
            return None
        ntz = c.c.cast("timestamp_ntz")
        if form is None:
            return Col(F.concat(F.date_format(ntz, "yyyy-MM-dd"), F.lit(" "), clock_text(interval_micros(ntz_time(ntz)))), TEXT, c.free)
        return Col(formatted("DateTime.ToText", ntz.cast("date"), ntz_time(ntz), form), TEXT, c.free)

    def time_text(v: Any, *rest: Any) -> Any:
        form = options("Time.ToText", rest)
        c = as_time(v, "Time.ToText")
        if c is None:
            return None
        return Col(clock_text(interval_micros(c.c)) if form is None else formatted("Time.ToText", None, c.c, form), TEXT, c.free)

    fn("Date.ToText", 1, 3, date_text)
    fn("DateTime.ToText", 1, 3, moment_text)
    fn("Time.ToText", 1, 3, time_text)

    # -- datetime
    def moment_from(v: Any, said: Any = None) -> Any:
        culture(said, "DateTime.From")
        c = as_datetime(v, "DateTime.From")
        return c if c is None or c.kind.name == "datetime" else Col(c.c.cast("timestamp_ntz"), DATETIME, c.free)

    fn("DateTime.From", 1, 2, moment_from)
    fn("DateTime.Date", 1, 1, lambda v: as_date(v, "DateTime.Date"))

    def wrapped(c: Col | None) -> Any:
        return None if c is None else Col(F.when(c.c.isNotNull(), time_value(c.c)), TIME, c.free)

    fn("DateTime.Time", 1, 1, lambda v: wrapped(as_time(v, "DateTime.Time")))
    for name in ("DateTime.LocalNow", "DateTime.FixedLocalNow"):
        fn(name, 0, 0, lambda: Col(F.localtimestamp(), DATETIME, True))

    def add_zone(v: Any, hours: Any, minutes: Any = 0) -> Any:
        if v is None:
            return None
        c = as_col(v)
        if c.kind.name == "datetimezone":
            raise EvalError("DateTime.AddZone: the value has a zone already")
        if c.kind.name not in ("datetime", "any"):
            raise EvalError("DateTime.AddZone needs a datetime")
        h, m = as_col(hours), as_col(minutes if minutes is not None else 0)
        return Col(to_instant(c.c, h.c.cast("int") * 60 + m.c.cast("int")), DATETIMEZONE, c.free and h.free and m.free)

    fn("DateTime.AddZone", 2, 3, add_zone)

    # -- durations
    fn("Duration.From", 1, 1, lambda v: as_duration(v, "Duration.From"))

    def of_duration(name: str, made: Any, whole: bool) -> None:
        def call(v: Any) -> Any:
            c = as_duration(v, name)
            return None if c is None else Col(made(interval_micros(c.c)), NUMBER, c.free, whole)

        fn(name, 1, 1, call)

    def component(size: int, most: int | None) -> Any:
        def made(total: Column) -> Column:
            n = F.floor(F.abs(total) / size)
            return (F.signum(total) * (n if most is None else n % most)).cast("long")

        return made

    for name, size, most in (("Days", MICROS, None), ("Hours", 3_600_000_000, 24), ("Minutes", 60_000_000, 60), ("Seconds", 1_000_000, 60)):
        of_duration(f"Duration.{name}", component(size, most), True)
    for name, size in (("Days", MICROS), ("Hours", 3_600_000_000), ("Minutes", 60_000_000), ("Seconds", 1_000_000)):
        of_duration(f"Duration.Total{name}", lambda total, size=size: (total / 1e6) / (size / 1e6), False)

    def duration_text(v: Any, form: Any = None) -> Any:
        if ev.const(form, "format") is not None:
            kit.refuse("a format of Duration.ToText")
        c = as_duration(v, "Duration.ToText")
        return None if c is None else Col(duration_as_text(c.c), TEXT, c.free)

    def duration_as_text(c: Column) -> Column:
        total = interval_micros(c)
        size = F.abs(total)
        return F.concat(F.when(total < 0, "-").otherwise(""), F.when(size >= MICROS, F.concat(F.floor(size / MICROS).cast("string"), F.lit("."))).otherwise(""), clock_text(size % MICROS))

    fn("Duration.ToText", 1, 2, duration_text)

    # -- times of day
    def time_from(v: Any, said: Any = None) -> Any:
        culture(said, "Time.From")
        return wrapped(as_time(v, "Time.From"))

    fn("Time.From", 1, 2, time_from)
    for name, size, most in (("Hour", 3_600_000_000, 24), ("Minute", 60_000_000, 60), ("Second", 1_000_000, 60)):

        def part(v: Any, name: str = name, size: int = size, most: int = most) -> Any:
            c = as_time(v, f"Time.{name}")
            return None if c is None else Col((F.floor(interval_micros(c.c) / size) % most).cast("long"), NUMBER, c.free, True)

        fn(f"Time.{name}", 1, 1, part)
    for k, day in enumerate(DAYS):
        kit.enum(f"Day.{day}", k)
    kit.duration_text, kit.as_duration_text = duration_as_text, parse_duration
    kit.clock_text = clock_text
    kit.checked = checked


