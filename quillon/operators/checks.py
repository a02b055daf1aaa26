"""Named checks of tables that end in one row each, and feature tables that count what fails.

A `CheckSuite` collects checks. Checks that are aggregates of one table are
fused: one scan of the table serves all of them, or none where the table is
written anyway and `watch` has its metrics observed in that pass. Checks that need joins or
several tables are functions from the tables to a one-row DataFrame. Whatever a
check raises becomes its row, so the others still report.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, functions as F

from quillon.operators.tables import SMALL_ROWS
from quillon.sources.files import shared_table

ROW = "check string, table string, status string, observed string, message string"


@dataclass(frozen=True)
class Check:
    """measures with holds (a fused check), or rule (a function of all tables)."""

    name: str
    table: str
    expected: str
    measures: Mapping[str, Column]
    holds: Callable[[Row], bool] | None
    rule: Callable[[Mapping[str, DataFrame]], DataFrame] | None


def _shown(values: Mapping) -> str:
    text = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return "; ".join(f"{k}={text(v)}" for k, v in values.items())


def _fault(e: Exception) -> str:
    """The condition of a Spark error, else the kind of error and its text."""
    named = e.getCondition() if isinstance(e, PySparkException) else None
    return named or f"{type(e).__name__}: {e}"


class CheckSuite:
    """Checks by name, in the order in which they were added."""

    def __init__(self) -> None:
        self.checks: list[Check] = []
        self.watched: dict[str, tuple[Observation, dict[str, Exception]]] = {}

    def _add(self, check: Check) -> None:
        if any(c.name == check.name for c in self.checks):
            raise ValueError(f"there is a check {check.name!r} already")
        self.checks.append(check)

    def measure(self, name: str, table: str, expected: str, holds: Callable[[Row], bool], **measures: Column) -> None:
        """A check of aggregates of one table; holds gets them by name."""
        self._add(Check(name, table, expected, measures, holds, None))

    def rule(self, name: str, table: str, expected: str):
        """Decorator for a function of all tables to one row with a boolean `holds`; other columns are what was observed."""

        def register(f: Callable[[Mapping[str, DataFrame]], DataFrame]):
            self._add(Check(name, table, expected, {}, None, f))
            return f

        return register

    def _fused(self, table: str, df: DataFrame) -> tuple[list[Column], dict[str, Exception]]:
        """Aggregates of all measured checks of the table that resolve, and the faults of the others."""
        columns, faults = [], {}
        for at, c in enumerate(self.checks):
            if c.holds and c.table == table:
                own = [m.alias(f"{at}.{k}") for k, m in c.measures.items()]
                try:
                    _ = df.agg(*own).schema
                    columns += own
                except Exception as e:  # noqa: BLE001 - whatever a check raises is its result
                    faults[c.name] = e
        return columns, faults

    def watch(self, table: str, df: DataFrame) -> DataFrame:
        """df with the table's measures observed by the next job that reads all of it, such as the one that writes it."""
        columns, faults = self._fused(table, df)
        observation = Observation(f"checks of {table}")
        self.watched[table] = observation, faults
        return df.observe(observation, *columns) if columns else df

    def _measured(self, table: str, df: DataFrame) -> tuple[dict, dict[str, Exception]]:
        if table in self.watched:
            observation, faults = self.watched.pop(table)
            return observation.get if any(c.holds and c.table == table and c.name not in faults for c in self.checks) else {}, faults
        columns, faults = self._fused(table, df)
        try:
            return (df.agg(*columns).first().asDict() if columns else {}), faults
        except Exception:  # noqa: BLE001 - one of them raises on the data: each alone tells which
            values = {}
            for at, c in enumerate(self.checks):
                if c.holds and c.table == table and c.name not in faults:
                    try:
                        values |= df.agg(*[m.alias(f"{at}.{k}") for k, m in c.measures.items()]).first().asDict()
                    except Exception as e:  # noqa: BLE001
                        faults[c.name] = e
            return values, faults

    def run(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """check, table, status (PASS, FAIL or ERROR), observed and message of every check; the message says what was expected, or the error."""
        spark = next(iter(tables.values())).sparkSession
        found = {t: self._measured(t, tables[t]) for t in dict.fromkeys(c.table for c in self.checks if c.holds) if t in tables}
        rows = []
        for at, c in enumerate(self.checks):
            observed = ""
            try:
                if c.table not in tables:
                    raise KeyError(c.table)
                if c.holds:
                    values, faults = found[c.table]
                    if c.name in faults:
                        raise faults[c.name]
                    own = Row(**{k: values[f"{at}.{k}"] for k in c.measures})
                    observed, holds = _shown(own.asDict()), c.holds(own)
                else:
                    own = c.rule(tables).limit(2).collect()
                    if len(own) != 1:
                        raise ValueError("a check gives one row")
                    observed, holds = _shown({k: v for k, v in own[0].asDict().items() if k != "holds"}), own[0]["holds"]
                rows.append((c.name, c.table, "PASS" if holds else "FAIL", observed, "" if holds else c.expected))
            except Exception as e:  # noqa: BLE001
                rows.append((c.name, c.table, "ERROR", observed, _fault(e)))
        return spark.createDataFrame(rows, ROW)


# Feature tables and profiles ---------------------------------------------------


def feature_table(df: DataFrame, ids: Sequence[str], features: Mapping[str, Column], valid: Column, reason: str = "invalid_or_missing_input") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of the valid rows, a report on each feature, and the invalid rows with the reason.

    A feature is an expression that gives null where it fails, such as those with
    try_ functions. Infinite values become null as well. One job writes the
    features, and what the report counts is observed in it: n_rows, n_missing,
    missing_fraction, n_infinite, n_failed (null before infinite values and NaN
    were taken out) and all_missing.
    """
    good = F.coalesce(valid, F.lit(False))
    raw = df.filter(good).select(*ids, *[x.cast("double").alias(n) for n, x in features.items()])
    infinite = lambda n: F.abs(F.col(f"`{n}`")) == float("inf")
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(features):
        c = F.col(f"`{n}`")
        counts += [F.count_if(c.isNull()).alias(f"f{i}"), F.count_if(infinite(n)).alias(f"i{i}"), F.count_if(c.isNull() | F.isnan(c) | infinite(n)).alias(f"m{i}")]
    seen = Observation("features")
    cleaned = raw.observe(seen, *counts).withColumns({n: F.when(~F.isnan(f"`{n}`") & ~infinite(n), F.col(f"`{n}`")) for n in features})
    made, got = shared_table(cleaned), seen.get
    n = got["rows"]
    rows = [(f, n, got[f"m{i}"], got[f"m{i}"] / n if n else None, got[f"i{i}"], got[f"f{i}"], n == got[f"m{i}"]) for i, f in enumerate(features)]
    report = df.sparkSession.createDataFrame(rows, "feature string, n_rows long, n_missing long, missing_fraction double, n_infinite long, n_failed long, all_missing boolean")
    return made, report, df.filter(~good).select(*ids, F.lit(reason).alias("reason"))


def _hashes(value: Column) -> list[Column]:
    """128 bits that stand for a value; null is a value of its own."""
    return [F.xxhash64(F.lit(seed), value, value.isNull()).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]


def _cells(df: DataFrame, cells: Sequence[Sequence[Column]]) -> DataFrame:
    """place, h1, h2, flag and n: how often each value occurs at each place, from one scan.

    A row becomes a small cell for each place within its task and is counted
    there, so what is shuffled are distinct values, by 128 bits.
    """
    made = [F.struct(F.lit(i).alias("place"), *c) for i, c in enumerate(cells)]
    return df.select(F.inline(F.array(*made))).groupBy("place", "h1", "h2").agg(F.first("flag").alias("flag"), F.count(F.lit(1)).alias("n"))


def _plain(df: DataFrame, column: str) -> Column:
    """A column as something that can be hashed: maps and variants as JSON."""
    kind = df.schema[column].dataType.simpleString()
    c = F.col(f"`{column}`")
    return F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c


def column_profile(df: DataFrame, columns: Sequence[str], failed: Mapping[str, int] | None = None) -> DataFrame:
    """column, n_rows, n_missing, n_distinct, is_constant, missing_fraction, n_infinite, n_failed and all_missing of each column.

    Distinct values leave out null; failed has counts of failures by column, as
    feature_table reports them.
    """
    numbers = {n for n, kind in df.dtypes if kind in ("float", "double")}
    flag = {c: F.when(F.col(f"`{c}`").isNull(), 1).when(F.abs(F.col(f"`{c}`")) == float("inf"), 2).otherwise(0) if c in numbers else F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in columns}
    counted = _cells(df, [[*_hashes(_plain(df, c)), flag[c].alias("flag")] for c in columns])
    each = counted.groupBy("place").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("flag") == 1, F.col("n")).otherwise(0)).alias("n_missing"), F.count_if(F.col("flag") != 1).alias("n_distinct"),
        F.sum(F.when(F.col("flag") == 2, F.col("n")).otherwise(0)).alias("n_infinite"),
    )
    names = df.sparkSession.createDataFrame([(i, c, (failed or {}).get(c, 0)) for i, c in enumerate(columns)], "place int, column string, n_failed long")
    found = F.broadcast(names).join(each, "place", "left") if len(columns) > SMALL_ROWS else names.join(F.broadcast(each), "place", "left")  # a row for each column
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_missing", "n_distinct", "n_infinite")}
    full = found.withColumns(zero)
    return full.select(
        "column", "n_rows", "n_missing", "n_distinct", (F.col("n_distinct") <= 1).alias("is_constant"), F.try_divide("n_missing", "n_rows").alias("missing_fraction"),
        "n_infinite", "n_failed", (F.col("n_missing") == F.col("n_rows")).alias("all_missing"),
    )


def place_counts(df: DataFrame, tests: Sequence[tuple[Sequence[str], Column | None]]) -> DataFrame:
    """place, rows, flagged and distinct for each test (columns, flag) by its place, from one scan.

    A test of columns counts distinct values of them, null too; one with a flag counts the rows for which it is 1.
    """
    cells = []
    for columns, flag in tests:
        value = F.struct(*[_plain(df, c).alias(f"_{i}") for i, c in enumerate(columns)]) if columns else flag
        nulls = [F.col(f"`{c}`").isNull() for c in columns]
        hashed = [F.xxhash64(F.lit(seed), value, *nulls).alias(h) for seed, h in ((1, "h1"), (2, "h2"))]
        cells.append([*hashed, (F.lit(0) if flag is None else flag).alias("flag")])
    return _cells(df, cells).groupBy("place").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("flag") == 1, F.col("n")).otherwise(0)).alias("flagged"), F.count(F.lit(1)).alias("distinct"))
