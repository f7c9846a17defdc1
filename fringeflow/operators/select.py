"""Selections: small text grammars parsed on the driver into Column predicates, so filters reach the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping, touching and adjacent ones joined. (Ranges that meet in one channel are joined too.)"""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def parse_channels(spec: str, n: int) -> list[tuple[int, int]]:
    """`n`, `a~b`, `<n`, `<=n`, `>n`, `>=n`, parted by commas or semicolons; blank selects all of n channels."""
    if not spec.strip():
        return [(0, n - 1)]
    out = []
    for p in re.split(r"[,;]", spec):
        p = p.strip()
        if m := re.fullmatch(r"(\d+)\s*~\s*(\d+)", p):
            lo, hi = int(m[1]), int(m[2])
        elif m := re.fullmatch(r"(<=|>=|<|>)\s*(\d+)", p):
            k = int(m[2])
            lo, hi = {"<": (0, k - 1), "<=": (0, k), ">": (k + 1, n - 1), ">=": (k, n - 1)}[m[1]]
        elif re.fullmatch(r"\d+", p):
            lo = hi = int(p)
        else:
            raise ValueError(f"no channel selection: {p!r}")
        if lo > hi or lo < 0 or hi >= n:
            raise ValueError(f"{p!r} is out of bounds 0~{n - 1}")
        out.append((lo, hi))
    return merge_ranges(out)


def in_ranges(column: Column, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, (column.between(lo, hi) for lo, hi in ranges), F.lit(False))


def channels(column: str, spec: str, n: int) -> Column:
    return in_ranges(F.col(column), parse_channels(spec, n))


# fixed values: names of polarization products, longest first
STOKES = ("PFtotal", "PFlinear", "Ptotal", "Plinear", "Pangle", "RR", "RL", "LR", "LL", "XX", "XY", "YX", "YY", "PP", "PQ", "QP", "QQ", "I", "Q", "U", "V")


def parse_stokes(spec: str) -> list[str]:
    """Names read greedily, the longest first: `IQUV`, `XXYY`, `I,V`."""
    out, s = [], re.sub(r"[\s,;]", "", spec)
    known = sorted(STOKES, key=len, reverse=True)
    while s:
        name = next((k for k in known if s.upper().startswith(k.upper())), None)
        if name is None:
            raise ValueError(f"no polarization at {s!r}")
        out.append(name)
        s = s[len(name) :]
    return out


def names(column: str, spec: str, id_column: str | None = None) -> Column:
    """Names, globs with *, or integer ids, parted by commas."""
    tests = []
    for p in filter(None, (x.strip() for x in spec.split(","))):
        if id_column and re.fullmatch(r"\d+", p):
            tests.append(F.col(id_column) == int(p))
        elif id_column and (m := re.fullmatch(r"(\d+)~(\d+)", p)):
            tests.append(F.col(id_column).between(int(m[1]), int(m[2])))
        elif "*" in p:
            tests.append(F.col(column).rlike("^" + ".*".join(map(re.escape, p.split("*"))) + "$"))
        else:
            tests.append(F.col(column) == p)
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


def antennas(spec: str, a: str = "ant1", b: str = "ant2") -> Column:
    """`3`, `3&7`, `3&*`, `3&&`: any baseline of 3, one baseline, cross ones of 3, its cross and auto ones; `3&&&` auto only.

    Parts are joined by semicolons, ids in a part by commas; a leading ! excludes.
    """
    keep, drop = [], []
    for p in filter(None, (x.strip() for x in spec.split(";"))):
        out = drop if p.startswith("!") else keep
        m = re.fullmatch(r"!?\s*([\d,~\s]+|\*)\s*(&{0,3})\s*([\d,~\s]*|\*)", p)
        if not m:
            raise ValueError(f"no antenna selection: {p!r}")
        x, op, y = m[1].strip(), m[2], m[3].strip()
        one = lambda c, s: F.lit(True) if s == "*" else in_ranges(F.col(c), [tuple(map(int, (r.split("~") * 2)[:2])) for r in s.split(",") if r.strip()])
        auto = F.col(a) == F.col(b)
        if op == "&&&":
            test = auto & one(a, x)
        elif not y and op in ("", "&&"):
            test = one(a, x) | one(b, x)
            test = test if op == "" else (auto & one(a, x)) | (~auto & one(a, x) & one(b, x))
        elif op == "&" and not y:
            test = ~auto & one(a, x) & one(b, x)
        else:
            test = (one(a, x) & one(b, y or x)) | (one(b, x) & one(a, y or x))
            test = test & ~auto if op == "&" else test
        out.append(test)
    got = reduce(lambda p, q: p | q, keep) if keep else F.lit(True)
    return reduce(lambda p, q: p & ~q, drop, got)


def seconds(text: str) -> float:
    """Seconds since 1970 of Y/M/D[/h:m:s], or seconds as they are."""
    text = text.strip()
    if m := re.fullmatch(r"(\d+)/(\d+)/(\d+)(?:[/ ](\d+)(?::(\d+)(?::([\d.]+))?)?)?", text):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
        k = (14 - mo) // 12
        yy, mm = y + 4800 - k, mo + 12 * k - 3
        days = d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - yy // 100 + yy // 400 - 32045 - 2440588
        return days * 86400.0 + int(m[4] or 0) * 3600 + int(m[5] or 0) * 60 + float(m[6] or 0)
    return float(text)


def times(column: str, spec: str) -> Column:
    """`t0~t1`, `>t`, `<t` or `t`, parted by commas; bounds belong to a range."""
    tests = []
    for p in filter(None, (x.strip() for x in spec.split(","))):
        c = F.col(column)
        if "~" in p:
            lo, hi = map(seconds, p.split("~"))
            tests.append(c.between(lo, hi))
        elif p[0] in "<>":
            tests.append(c < seconds(p[1:]) if p[0] == "<" else c > seconds(p[1:]))
        else:
            tests.append(c == seconds(p))
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


def uv_range(u: str, v: str, spec: str) -> Column:
    """`a~b`, `<a`, `>a` of the length of (u, v)."""
    d = F.hypot(F.col(u), F.col(v))
    spec = spec.strip()
    if not spec:
        return F.lit(True)
    if "~" in spec:
        lo, hi = map(float, spec.split("~"))
        return d.between(lo, hi)
    return d < float(spec[1:]) if spec[0] == "<" else d > float(spec[1:])


def select(df: DataFrame, axes: dict[str, str], **spec: str) -> DataFrame:
    """Keyed selection, one predicate an axis, joined by AND.

    axes maps scan, spw, field, time, antenna, uvdist, intent, array, observation, feed to columns of df.
    """
    tests = []
    for axis, text in spec.items():
        if not text:
            continue
        if axis == "time":
            tests.append(times(axes["time"], text))
        elif axis == "antenna":
            tests.append(antennas(text, *axes["antenna"].split(",")))
        elif axis == "uvdist":
            tests.append(uv_range(*axes["uvdist"].split(","), text))
        else:
            column = axes[axis]
            kind = dict(df.dtypes)[column]
            tests.append(names(column, text, column if kind in ("int", "bigint", "smallint") else None))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def unflagged(flag_row: str, flag: str) -> Column:
    """NOT (FLAG_ROW OR ALL(FLAG))."""
    return ~(F.col(flag_row) | F.forall(flag, lambda x: x))


def strided(df: DataFrame, row_id: str, start: int, count: int, step: int = 1) -> DataFrame:
    """Cells start, start + step, ... of a column scan: at most `count` of them."""
    r = F.col(row_id)
    return df.where((r >= start) & ((r - start) % step == 0) & (r < start + count * step))


def sorted_rules(df: DataFrame, rules: list[tuple[str, str, object, bool]]) -> DataFrame:
    """Browser filter rules (field, comparator, value, negate); a row passes all. Field ANY tests every column's text."""
    ops = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, ">": lambda c, v: c > v, "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v)))}
    for field, op, value, negate in rules:
        cols = df.columns if field == "ANY" else [field]
        test = reduce(lambda a, b: a | b, (ops[op](F.col(c), value) for c in cols))
        df = df.where(~test if negate else test)
    return df


# --- rows, keys and groups ----------------------------------------------------------------------------------------
def row_fields(df: DataFrame, names: list[str], exclude: bool = False) -> DataFrame:
    """Row objects of some columns, or of all but some, as one struct column `row`."""
    keep = [c for c in df.columns if (c in names) != exclude]
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no columns {', '.join(missing)}")
    return df.select(F.struct(*keep).alias("row"))


def is_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether no two rows agree in these columns. A group of equal keys is counted, none is gathered."""
    return df.groupBy(*columns).agg(F.count("*").alias("_n")).agg((F.coalesce(F.max("_n"), F.lit(1)) == 1).alias("unique"))


def rows_of_key(df: DataFrame, key: dict[str, object]) -> DataFrame:
    """Rows whose columns have these values; a null value matches null."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in key.items())))


def rows_between(df: DataFrame, lower: dict[str, object], upper: dict[str, object], lower_included: bool = True, upper_included: bool = True) -> DataFrame:
    """Rows whose key lies between two, compared column after column."""
    key = F.struct(*lower)
    lo, hi = (F.struct(*(F.lit(v).alias(c) for c, v in b.items())) for b in (lower, upper))
    return df.where((key >= lo if lower_included else key > lo) & (key <= hi if upper_included else key < hi))


def cross_correlations(a: str, b: str) -> Column:
    return F.col(a) != F.col(b)


def auto_correlations(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)


def autocorrelation_status(df: DataFrame, antenna: str, a: str, b: str, flag: Column) -> DataFrame:
    """Per antenna N: it has no autocorrelations; F: all of them are flagged; R: some can be read."""
    auto = auto_correlations(a, b)
    status = F.when(F.max(auto), F.when(F.min(F.when(auto, flag)), "F").otherwise("R")).otherwise("N")
    return df.groupBy(antenna).agg(status.alias("status"))


def observation(df: DataFrame, keys: list[str], time_col: str, flag: Column | None = None) -> DataFrame:
    """The scan listing: first and last time, rows and unflagged rows of each combination of the keys."""
    good = (~flag) if flag is not None else F.lit(True)
    return df.groupBy(*keys).agg(F.min(time_col).alias("start"), F.max(time_col).alias("stop"), F.count("*").alias("rows"), F.sum(good.cast("long")).alias("unflagged"))


def having(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """Rows that have a partner in the other table."""
    return df.join(other, on, "left_semi")


def lacking(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    return df.join(other, on, "left_anti")


# --- names and ids ------------------------------------------------------------------------------------------------
def ids_of(dimension: DataFrame, id_col: str, name_col: str, spec: str) -> list[int]:
    """Ids of a dimension table's rows by ids, ranges of ids, names, globs or beginnings of names, parted by commas.

    A beginning counts if no whole name matches. The dimension's table is short and is read by the driver.
    """
    rows = dimension.select(F.col(id_col).cast("long"), F.col(name_col).cast("string")).collect()
    found: set[int] = set()
    for p in filter(None, (x.strip() for x in spec.split(","))):
        if m := re.fullmatch(r"(\d+)(?:~(\d+))?", p):
            hit = {i for i, _ in rows if int(m[1]) <= i <= int(m[2] or m[1])}
        elif "*" in p or "?" in p:
            pattern = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p))
            hit = {i for i, n in rows if n is not None and pattern.fullmatch(n)}
        else:
            hit = {i for i, n in rows if n == p} or {i for i, n in rows if n is not None and n.lower().startswith(p.lower())}
        if not hit:
            raise ValueError(f"nothing is selected by {p!r}")
        found |= hit
    return sorted(found) if spec.strip() else sorted(i for i, _ in rows)


def indices(dimensions: dict[str, tuple[DataFrame, str, str]], **spec: str) -> dict[str, list[int]]:
    """Expressions to lists of ids: axis -> (dimension table, id column, name column), and what is selected of it."""
    return {axis: ids_of(*dimensions[axis], text) for axis, text in spec.items()}


def data_description_ids(descriptions: DataFrame, spws: list[int], id_col: str = "ddid", spw_col: str = "spw") -> DataFrame:
    """The data descriptions that some spectral windows have, flagged ones left out if they are told."""
    d = descriptions.where(F.col(spw_col).isin(spws))
    return (d.where(~F.col("flag_row")) if "flag_row" in descriptions.columns else d).select(id_col)


def antenna_names(spec: str, antennas_by_name: dict[str, int]) -> str:
    """A baseline selection with names, as one with ids. Names are replaced whole, the longest first."""
    for name in sorted(antennas_by_name, key=len, reverse=True):
        spec = re.sub(rf"(?<![\w@]){re.escape(name)}(?![\w@])", str(antennas_by_name[name]), spec)
    return spec


def times_in_short(column: str, spec: str, day: str) -> Column:
    """Time selections whose parts may leave out the day, the hours or the minutes: `09:14:0~09:54:0`, `>10:24`, `10:20`.

    A bound without a day is of the day given, or of the range's first bound; `t+span` reaches from t over a span; a time
    without seconds stands for its whole minute, one without minutes for its whole hour.
    """

    def whole(text: str, of: str) -> tuple[str, float]:
        text = text.strip()
        if "/" not in text.split(":")[0]:
            text = f"{of}/{text}"
        clock = text.split("/")[3] if text.count("/") > 2 else ""
        return text, {0: 3600.0, 1: 60.0}.get(clock.count(":"), 0.0) if clock else 86400.0

    tests = []
    for p in filter(None, (x.strip() for x in spec.split(","))):
        c = F.col(column)
        if "~" in p:
            lo, hi = p.split("~")
            first, _ = whole(lo, day)
            last, _ = whole(hi, "/".join(first.split("/")[:3]))
            tests.append(c.between(seconds(first), seconds(last)))
        elif "+" in p:
            at, span = p.split("+")
            h, m, s = ([*map(float, span.split(":")), 0.0, 0.0])[:3]
            t = seconds(whole(at, day)[0])
            tests.append(c.between(t, t + 3600 * h + 60 * m + s))
        elif p[0] in "<>":
            t = seconds(whole(p[1:], day)[0])
            tests.append(c < t if p[0] == "<" else c > t)
        else:
            text, span = whole(p, day)
            t = seconds(text)
            tests.append((c >= t) & (c < t + span) if span else c == t)
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


# --- browsing -----------------------------------------------------------------------------------------------------
def sort_by(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sorted by (column, ascending) keys, nulls last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys))


def locate(df: DataFrame, row_id: str, rules: list[tuple[str, str, object, bool]]) -> DataFrame:
    """Ids of the rows that pass the browser's rules."""
    return sorted_rules(df, rules).select(row_id)


def listing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Formatted projection: each column by a format such as `%6.3f` or `%s`, and the line that they make."""
    cells = [F.format_string(f, F.col(c)) for c, f in columns.items()]
    return df.select(*(x.alias(c) for x, c in zip(cells, columns)), F.concat_ws(" ", *cells).alias("line"))


def validate(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Values of a text column that are not of a kind; blank ones count as not of it."""
    return df.where(F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` AS {kind})").isNull()).select(column)
