"""Read-only SQL over listed views: what a role may see is what is registered for it.

The text goes to Spark's own parser; nothing is parsed here. A query runs in a session of its own whose temporary views
are the role's, cut to the caller's own runs and sources, so other rows, tables and columns do not resolve. The analysed
plan is walked down to those views: it may consist of reading nodes and listed expressions only. Literals are values, so a
text that mentions a command inside quotes is no command. Results are limited, and a query that takes too long is ended.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROWS, MOST_ROWS, SECONDS, ATTEMPTS = 50, 100, 5, 3
#: Views that each role may read.
ROLE_VIEWS = {
    "viewer": ("outputs", "customers"),
    "analyst": ("outputs", "customers", "payments", "usage", "features", "runs"),
    "admin": ("outputs", "customers", "payments", "usage", "features", "runs"),
}
#: Plan nodes that read.
NODES = {"Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "OneRowRelation"}
#: Expressions: columns and values, comparisons, arithmetic, CASE, and the listed functions (count, sum, avg, min, max,
#: coalesce, round, date_trunc, extract, now, current_date).
EXPRESSIONS = {
    "AttributeReference", "Literal", "Alias", "SortOrder", "Cast", "OuterReference", "ScalarSubquery", "ListQuery", "Exists", "InSubquery", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual",
    "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not", "IsNull", "IsNotNull", "In", "Between", "Like", "ILike", "Lower", "Upper", "CaseWhen", "If", "Add", "Subtract", "Multiply", "Divide", "UnaryMinus",
    "AggregateExpression", "Count", "Sum", "Average", "Min", "Max", "Coalesce", "Round", "TruncTimestamp", "TruncDate", "Extract", "Year", "Quarter", "Month", "DayOfMonth", "DayOfYear", "DayOfWeek", "WeekOfYear", "Hour", "Minute", "Second",
    "SecondWithFraction", "Now", "CurrentTimestamp", "CurrentDate", "TimeAdd", "TimestampAddInterval", "DateAdd", "DateSub", "DateAddInterval", "DateAddYMInterval", "TimestampAddYMInterval", "SubtractDates", "SubtractTimestamps", "MakeInterval", "KnownNotNull", "With", "CommonExpressionDef", "CommonExpressionRef",
}
_ID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)


class Refused(ValueError):
    """Why a query was not run."""


@dataclass(frozen=True)
class Scope:
    """The caller's own runs and sources, and the run that the conversation is bound to, if any."""

    run_ids: frozenset[str] = field(default_factory=frozenset)
    source_ids: frozenset[str] = field(default_factory=frozenset)
    bound_run: str | None = None

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` without the rows of other callers, by the id columns that it has."""
        if "prediction_run_id" in df.columns:
            df = df.where(F.col("prediction_run_id").isin([self.bound_run] if self.bound_run else sorted(self.run_ids)))
        if "source_id" in df.columns:
            df = df.where(F.col("source_id").isin(sorted(self.source_ids)))
        return df


def _seq(items) -> Iterator:
    for i in range(items.size()):
        yield items.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(node) -> Iterator[str]:
    yield _kind(node)
    for child in _seq(node.children()):
        yield from _expressions(child)


def _check(plan, allowed: tuple[str, ...]) -> None:
    """Raise for anything but reading nodes and listed expressions above the role's views."""
    kind = _kind(plan)
    if kind == "View":
        if plan.desc().identifier().table() not in allowed:
            raise Refused(f"no such view: {plan.desc().identifier().table()}")
        return  # what is below is the view's own
    if kind not in NODES:
        raise Refused(f"not a reading query: {kind}")
    for e in _seq(plan.expressions()):
        for name in _expressions(e):
            if name not in EXPRESSIONS:
                raise Refused(f"not allowed: {name}")
    for part in (*_seq(plan.children()), *_seq(plan.subqueries())):
        _check(part, allowed)


def _star(plan) -> bool:
    """Whether a SELECT list has a star (count(*) has one inside, which is allowed)."""
    own = any(_kind(e).startswith("UnresolvedStar") for e in _seq(plan.expressions()))
    return own or any(_star(p) for p in (*_seq(plan.children()), *_seq(plan.subqueries())))


def run_guarded(spark: SparkSession, sql: str, role: str, views: dict[str, Callable[[SparkSession], DataFrame]], rows: int = DEFAULT_ROWS, scope: Scope | None = None) -> DataFrame:
    """The result of one SELECT over the role's views, at most ``rows`` (MOST_ROWS at most) rows.

    ``views`` build each view in the session that they are given; with a ``scope`` each shows the caller's own rows only,
    and a query that names the id of another run or source is refused.
    """
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if not re.match(r"(?i)select\b", text) or "$$" in text:
        raise Refused("only SELECT is allowed")
    if scope is not None and (other := {i.lower() for i in _ID.findall(text)} - {i.lower() for i in scope.run_ids | scope.source_ids}):
        raise Refused(f"not an id of yours: {min(other)}")
    session, allowed = spark.newSession(), ROLE_VIEWS.get(role, ())
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name in allowed:
        if name in views:
            view = views[name](session)
            (scope.cut(view) if scope is not None else view).createOrReplaceTempView(name)
    try:
        if _star(session._jsparkSession.sessionState().sqlParser().parsePlan(text)):
            raise Refused("name the columns instead of *")
        result = session.sql(text)
    except (ParseException, AnalysisException) as why:
        raise Refused(str(why).split("\n")[0]) from why
    _check(result._jdf.queryExecution().analyzed(), allowed)
    return result.limit(max(1, min(rows, MOST_ROWS)))


def fetch(df: DataFrame, seconds: float = SECONDS) -> list[dict]:
    """The rows of a limited result with dates as text; the query is cancelled after so many seconds."""
    context, group = df.sparkSession.sparkContext, f"guarded-{uuid.uuid4()}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        rows = df.collect()
    except Exception as why:
        if late.is_set():
            raise Refused(f"took longer than {seconds} seconds") from why
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    shown = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    return [{k: shown(v) for k, v in r.asDict().items()} for r in rows]


def ask(propose: Callable[[str | None], str], run: Callable[[str], DataFrame], attempts: int = ATTEMPTS, seconds: float = SECONDS) -> list[dict]:
    """Rows of the first proposed query that is allowed; the reason for a refusal goes into the next proposal."""
    reason: str | None = None
    for _ in range(attempts):
        try:
            return fetch(run(propose(reason)), seconds)
        except Refused as why:
            reason = str(why)
    raise Refused(f"no allowed query in {attempts} attempts: {reason}")
