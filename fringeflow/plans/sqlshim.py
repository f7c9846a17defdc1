"""The table query dialect on Spark SQL.

SELECT [DISTINCT] .. FROM .. WHERE .. GROUPBY .. HAVING .. ORDERBY [DISTINCT] .. LIMIT .. OFFSET .., COUNT .., CALC ..,
UPDATE .. SET .., INSERT INTO .. VALUES .., DELETE FROM .., CREATE TABLE .. AS ... Tables are not changed in place: a
command that changes one gives the changed table, which the caller writes as a new version.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SELECT = re.compile(
    r"^\s*SELECT\s+(?P<distinct>DISTINCT\s+)?(?P<columns>.*?)\s*(?:FROM\s+(?P<table>\S+)\s*)?(?:WHERE\s+(?P<where>.*?)\s*)?"
    r"(?:GROUP\s*BY\s+(?P<group>.*?)\s*)?(?:HAVING\s+(?P<having>.*?)\s*)?(?:ORDER\s*BY\s+(?P<unique>DISTINCT\s+)?(?P<order>.*?)\s*)?"
    r"(?:LIMIT\s+(?P<limit>\d+)\s*)?(?:OFFSET\s+(?P<offset>\d+)\s*)?$",
    re.I | re.S,
)
_UPDATE = re.compile(r"^\s*UPDATE\s+\S+\s+SET\s+(?P<set>.*?)\s*(?:FROM\s+\S+\s*)?(?:WHERE\s+(?P<where>.*?)\s*)?$", re.I | re.S)
_INSERT = re.compile(r"^\s*INSERT\s+INTO\s+\S+\s*(?:\((?P<columns>[^)]*)\)\s*)?VALUES\s*(?P<values>.*?)\s*$", re.I | re.S)
_DELETE = re.compile(r"^\s*DELETE\s+FROM\s+\S+\s*(?:WHERE\s+(?P<where>.*?)\s*)?$", re.I | re.S)
_COUNT = re.compile(r"^\s*COUNT\s+(?P<columns>.*?)\s+FROM\s+\S+\s*(?:WHERE\s+(?P<where>.*?)\s*)?$", re.I | re.S)
_CALC = re.compile(r"^\s*CALC\s+(?:FROM\s+\S+\s+CALC\s+)?(?P<what>.*?)\s*(?:FROM\s+\S+\s*)?(?:WHERE\s+(?P<where>.*?)\s*)?$", re.I | re.S)
_CREATE = re.compile(r"^\s*CREATE\s+TABLE\s+(?P<name>\S+)\s+AS\s+(?P<select>SELECT\s.*)$", re.I | re.S)

# functions over the elements of an array cell: Spark's words for them, with the argument in place of {}
_ARRAY = {
    "all": "forall({}, _x -> _x)", "any": "exists({}, _x -> _x)", "ntrue": "size(filter({}, _x -> _x))", "nfalse": "size(filter({}, _x -> not _x))", "nelements": "size({})", "shape": "array(size({}))",
    "sums": "aggregate({}, 0D, (_a, _x) -> _a + _x)", "sumsqr": "aggregate({}, 0D, (_a, _x) -> _a + _x * _x)", "means": "aggregate({}, 0D, (_a, _x) -> _a + _x, _a -> _a / size({}))",
    "mins": "array_min({})", "maxs": "array_max({})", "iif": "if({})", "square": "pow({}, 2)", "sqr": "pow({}, 2)", "upcase": "upper({})", "downcase": "lower({})", "strlength": "length({})",
}


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets and strings."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


def _calls(text: str) -> str:
    """Array functions in Spark's words, inner ones first."""
    while m := re.search(rf"\b({'|'.join(_ARRAY)})\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)(?!\s*->)", text, re.I):
        inner = _calls(m[2])
        done = _ARRAY[m[1].lower()].replace("{}", inner)
        # a mark keeps words that Spark shares with the dialect from being found again
        text = text[: m.start()] + re.sub(r"\b([A-Za-z_]+)\(", "\\1\x00(", done) + text[m.end() :]
    return text


def expression(text: str) -> str:
    """==, &&, ||, !, IN [..] with ranges, pattern tests and array functions in Spark's words; strings stay as they are."""

    def ranges(m: re.Match) -> str:
        tests, values = [], []
        for p in _parts(m[2]):
            if r := re.fullmatch(r"(.+?)\s*:\s*(.+)", p):
                tests.append(f"{m[1]} BETWEEN {r[1]} AND {r[2]}")
            else:
                values.append(p)
        if values:
            tests.append(f"{m[1]} IN ({', '.join(values)})")
        return "(" + " OR ".join(tests) + ")"

    text = re.sub(r"([\w.]+)\s+IN\s*\[([^\]]*)\]", ranges, text, flags=re.I)
    text = re.sub(r"([\w.]+)\s*!~\s*p/([^/]*)/", lambda m: f"NOT ({m[1]} LIKE '{_like(m[2])}')", text)
    text = re.sub(r"([\w.]+)\s*~\s*p/([^/]*)/", lambda m: f"({m[1]} LIKE '{_like(m[2])}')", text)
    text = re.sub(r"([\w.]+)\s*~\s*m/([^/]*)/", r"(\1 RLIKE '\2')", text)
    out = []
    for i, part in enumerate(re.split(r"('(?:[^']|'')*'|\"[^\"]*\")", text)):
        if i % 2 == 0:
            part = part.replace("&&", " AND ").replace("||", " OR ")
            part = re.sub(r"!(?!=)", " NOT ", part)
        elif part.startswith('"'):
            part = "'" + part[1:-1].replace("'", "''") + "'"
        out.append(part)
    return _calls("".join(out)).replace("\x00", "")


def _like(glob: str) -> str:
    return glob.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")


def _where(df: DataFrame, text: str | None) -> DataFrame:
    return df.where(expression(text)) if text else df


def command(df: DataFrame, text: str) -> DataFrame:
    """Runs any command of the dialect over df, whatever table it names."""
    if m := _CREATE.match(text):
        out = query(df, m["select"])
        out.createOrReplaceTempView(m["name"])
        return out
    if m := _COUNT.match(text):
        columns = _parts(m["columns"])
        return _where(df, m["where"]).groupBy(*columns).agg(F.count("*").alias("_count_"))
    if m := _UPDATE.match(text):
        test = F.expr(expression(m["where"])) if m["where"] else F.lit(True)
        new = {}
        for p in _parts(m["set"]):
            name, _, value = p.partition("=")
            name = name.strip()
            new[name] = F.when(test, F.expr(expression(value)).cast(df.schema[name].dataType)).otherwise(F.col(name))
        return df.withColumns(new)
    if m := _DELETE.match(text):
        # rows for which the test is unknown stay
        return df.where(~F.coalesce(F.expr(expression(m["where"])), F.lit(False))) if m["where"] else df.limit(0)
    if m := _INSERT.match(text):
        columns = _parts(m["columns"]) if m["columns"] else df.columns
        rows = []
        for p in re.findall(r"\(((?:[^()']|'(?:[^']|'')*')*)\)", m["values"]):
            values = dict(zip(columns, (F.expr(expression(v)) for v in _parts(p)), strict=True))
            rows.append(F.struct(*((values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema)))
        return df.unionByName(df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    if re.match(r"\s*CALC\b", text, re.I) and (m := _CALC.match(text)):
        return _where(df, m["where"]).select(F.expr(expression(m["what"])).alias("result"))
    return query(df, text)


def query(df: DataFrame, command: str) -> DataFrame:
    """Runs a SELECT over df, whatever table it names. ORDERBY DISTINCT keeps one row for each key."""
    m = _SELECT.match(command)
    if not m:
        raise ValueError(f"not a query: {command!r}")
    df = _where(df, m["where"])
    columns = _parts(m["columns"]) if m["columns"] and m["columns"] != "*" else []
    if m["group"]:
        keys = _parts(m["group"])
        exprs = [F.expr(expression(c)) for c in columns if c not in keys]
        df = df.groupBy(*(F.expr(expression(k)).alias(k) for k in keys)).agg(*exprs)
        if m["having"]:
            df = df.where(expression(m["having"]))
        columns = [re.split(r"\s+AS\s+", c, flags=re.I)[-1] for c in columns]
    if m["order"]:
        keys = _parts(m["order"])
        plain = [re.sub(r"\s+(ASC|DESC)$", "", k, flags=re.I) for k in keys]
        if m["unique"]:
            df = df.dropDuplicates(plain)
        df = df.orderBy(*(F.expr(p).desc() if re.search(r"\sDESC$", k, re.I) else F.expr(p).asc() for p, k in zip(plain, keys)))
    if columns:
        df = df.selectExpr(*(expression(c) for c in columns))
    if m["distinct"]:
        df = df.distinct()
    if m["offset"]:
        df = df.offset(int(m["offset"]))
    return df.limit(int(m["limit"])) if m["limit"] else df
