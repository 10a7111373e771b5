"""Filtered, scoped and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagewatch import schema as S
from stagewatch.functions.ladders import stage_index
from stagewatch.functions.times import instant
from stagewatch.plans.sequence import chunk_of

MAX_PAGE = 100
DEFAULT_PAGE = 20
DEEP_OFFSET = 100_000
SLICES = 1000


def clamp_page(page: int, size: int) -> tuple[int, int, int]:
    """(page, size, offset) with page at least 1 and size in 1..100."""
    page, size = max(1, page), min(MAX_PAGE, max(1, size))
    return page, size, (page - 1) * size


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def _skip(df: DataFrame, at: str, newest_first: bool, offset: int, size: int) -> tuple[DataFrame, int]:
    """The time slices that hold the rows offset..offset+size, and the offset left within them.

    A thousand slices of about equal size are counted, so a page far back does not make every task
    and the driver keep all rows before it. The counts are exact, whatever the borders are. Rows without a
    time are a slice of their own, before all others in ascending order as Spark sorts them.
    """
    micros = F.unix_micros(at)
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    borders = sorted(set(df.agg(F.percentile_approx(micros, shares, F.lit(10_000))).first()[0] or []))
    if not borders:
        return df, offset
    place = F.when(micros.isNull(), F.lit(-1)).otherwise(chunk_of(F.array(*[F.lit(b) for b in borders]), micros))
    counts = {r["s"]: r["n"] for r in df.groupBy(place.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(counts, reverse=newest_first)
    before, wanted = 0, []
    for s in order:
        if not wanted and before + counts[s] <= offset:
            before += counts[s]
            continue
        wanted.append(s)
        if before + sum(counts[w] for w in wanted) >= offset + size:
            break
    if not wanted:
        return df.where(F.lit(False)), 0
    low, high = min(wanted), max(wanted)
    inside = F.col(at).isNotNull() if high >= 0 else F.lit(False)
    if low > 0:
        inside = inside & (F.col(at) >= F.timestamp_micros(F.lit(borders[low - 1])))
    if 0 <= high < len(borders):
        inside = inside & (F.col(at) < F.timestamp_micros(F.lit(borders[high])))
    # Beside other slices the rows without a time matter only if theirs is among the wanted.
    return df.where(F.coalesce(inside, F.lit(False)) | F.col(at).isNull() if low < 0 else inside), offset - before


def paginate(
    df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE, by: str | None = None,
    newest_first: bool = True,
) -> DataFrame:
    """One page in a total order; the sort keeps only the rows up to the end of the page.

    ``by`` names the timestamp the order starts with. Pages deep in the listing are then first
    narrowed to the time slices that hold them.
    """
    _, size, offset = clamp_page(page, size)
    if by is not None and offset > DEEP_OFFSET:
        df, offset = _skip(df, by, newest_first, offset, size)
    return df.orderBy(*order).offset(offset).limit(size)


def page_totals(df: DataFrame, size: int = DEFAULT_PAGE) -> DataFrame:
    """Row count and number of pages of a listing, as one row."""
    _, size, _ = clamp_page(1, size)
    total = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(size))).cast("bigint")
    return df.agg(total.alias("total"), pages.alias("pages"))


def _moment(value) -> Column | None:
    """A bound as an instant; text that is no timestamp is ignored."""
    if value is None:
        return None
    try:
        return instant(value)
    except ValueError:
        return None


def _where(df: DataFrame, equal: dict, at: str, start, end) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    low, high = _moment(start), _moment(end)
    if low is not None:
        df = df.where(F.col(at) >= low)
    if high is not None:
        df = df.where(F.col(at) <= high)
    return df


def filter_events(events: DataFrame, request_id=None, department=None, event_type=None, start=None, end=None) -> DataFrame:
    equal = {"request_id": request_id, "department": department, "event_type": event_type}
    return _where(events, equal, "occurred_at", start, end)


def list_events(events: DataFrame, page: int = 1, size: int = DEFAULT_PAGE, **filters) -> DataFrame:
    """One page of events, newest first."""
    return paginate(filter_events(events, **filters), [F.desc("occurred_at"), F.asc("id")], page, size, "occurred_at")


def filter_alerts(
    alerts: DataFrame, severity=None, alert_type=None, lifecycle_state=None, start=None, end=None, request_id=None
) -> DataFrame:
    equal = {
        "severity": severity, "alert_type": alert_type, "lifecycle_state": lifecycle_state, "request_id": request_id,
    }
    return _where(alerts, equal, "created_at", start, end)


def list_alerts(alerts: DataFrame, page: int = 1, size: int = DEFAULT_PAGE, **filters) -> DataFrame:
    """One page of alerts, newest first."""
    return paginate(filter_alerts(alerts, **filters), [F.desc("created_at"), F.asc("id")], page, size, "created_at")


def recent_alerts(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The newest alerts nobody has acknowledged."""
    return alerts.where(F.col("lifecycle_state") == "Created").orderBy(F.desc("created_at"), "id").limit(n)


def critical_alerts(alerts: DataFrame) -> DataFrame:
    """Unacknowledged critical alerts, in all and by the two main types."""
    kind = F.col("alert_type")
    return alerts.where((F.col("severity") == "Critical") & (F.col("lifecycle_state") == "Created")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == S.SLA_BREACH).alias("sla_breach"),
        F.count_if(kind == S.CRITICAL_DELAY).alias("critical_delay"),
    )


def scope_requests(requests: DataFrame, role: str, department: str | None = None) -> DataFrame:
    """Requests a role may see: all for administrators and managers, else its department's.

    A scoped role without a department sees nothing.
    """
    if role in S.UNSCOPED_ROLES:
        return requests
    if department is None:
        return requests.where(F.lit(False))
    return requests.where(F.col("assigned_department") == department)


def filter_requests(requests: DataFrame, department=None, stage=None, status=None) -> DataFrame:
    equal = {"assigned_department": department, "current_stage": stage, "current_status": status}
    return _where(requests, equal, "created_at", None, None)


def list_requests(requests: DataFrame, role: str, department=None, page: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """One page of the requests a role may see, oldest first."""
    order = [F.asc("created_at"), F.asc("id")]
    return paginate(scope_requests(requests, role, department), order, page, size, "created_at", newest_first=False)


def search_requests(requests: DataFrame, text: str) -> DataFrame:
    """Requests whose number or customer contains the text, ignoring case."""
    wanted = F.lower(F.lit(text))
    return requests.where(
        F.lower("request_number").contains(wanted) | F.lower("customer_name").contains(wanted)
    )


def page_after(df: DataFrame, size: int = DEFAULT_PAGE, last: tuple | None = None, at: str = "occurred_at", newest_first: bool = True) -> DataFrame:
    """The page behind the row ``last`` = (time, id) of the one before; the first page without it.

    Nothing is counted and nothing skipped over: the filter on the time reaches the scan, and the page is the head of
    what is left. The order is by time and then by id, so pages put end to end are the listing; rows without a time
    are the oldest.
    """
    if last is not None:
        when, behind = last[0], F.col("id") > F.lit(last[1])
        if when is None:
            rest = F.col(at).isNull() & behind
            df = df.where(rest if newest_first else rest | F.col(at).isNotNull())
        else:
            moment = instant(when)
            beyond = (F.col(at) < moment) if newest_first else (F.col(at) > moment)
            rest = beyond | ((F.col(at) == moment) & behind)
            df = df.where(rest | F.col(at).isNull() if newest_first else rest)
    order = F.desc(at) if newest_first else F.asc(at)
    return df.orderBy(order, "id").limit(clamp_page(1, size)[1])


GRAM = 3  # characters of a posting
SEARCHED = ("request_number", "customer_name")


def _grams(text: Column) -> Column:
    """The distinct pieces of ``GRAM`` characters of a text, in lower case; none of a shorter or missing one."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, pieces).otherwise(F.array().cast("array<string>"))


def search_index(requests: DataFrame) -> DataFrame:
    """(gram, id): in which requests each piece of three characters occurs. Stored by gram, a search reads few of them."""
    both = F.array_distinct(F.concat(*[_grams(F.coalesce(F.col(c), F.lit(""))) for c in SEARCHED]))
    return requests.select(F.explode(both).alias("gram"), "id").distinct()


def search_by_index(requests: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """``search_requests`` by postings: requests that have all pieces of the text, then the exact test.

    A text of fewer than three characters has no pieces; all requests are scanned for it.
    """
    asked = index.sparkSession.range(1).select(F.explode(_grams(F.lit(text))).alias("gram"))
    wanted = [r["gram"] for r in asked.collect()]  # as many as the text has characters
    if not wanted:
        return search_requests(requests, text)
    met = index.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return search_requests(requests.join(met.select("id"), "id", "left_semi").select(*requests.columns), text)


def get_request(requests: DataFrame, key: str, role: str = "Administrator", department=None) -> DataFrame:
    """The request with this id or number, if the role may see it."""
    match = (F.col("id") == key) | (F.col("request_number") == key)
    return scope_requests(requests, role, department).where(match).limit(1)


def delayed_requests(requests: DataFrame, n: int = 50) -> DataFrame:
    """Breached requests, last changed first."""
    return requests.where("sla_breached").orderBy(F.desc("updated_at"), "id").limit(n)


def stage_progress(requests: DataFrame) -> DataFrame:
    """Eight rows per request: each stage done, active or pending; cancelled ones have none done."""
    steps = F.posexplode(F.array(*[F.lit(s) for s in S.PROGRESS_STAGES])).alias("place", "stage")
    here = stage_index(F.col("current_stage"))
    rows = requests.select("id", here.alias("_here"), steps)
    state = (
        F.when(F.col("place") < F.col("_here"), "done")
        .when(F.col("place") == F.col("_here"), "active")
        .otherwise("pending")
    )
    return rows.select("id", F.col("place").cast("bigint").alias("place"), "stage", state.alias("state"))


def permission_matrix(spark) -> DataFrame:
    """Role and permission pairs (60 at most, by the enumerations)."""
    pairs = [(role, permission) for permission, roles in S.PERMISSION_ROLES.items() for role in roles]
    return spark.createDataFrame(pairs, "role string, permission string")


def user_permissions(users: DataFrame) -> DataFrame:
    """Permissions of every user through the role."""
    return users.join(F.broadcast(permission_matrix(users.sparkSession)), "role")


def require(users: DataFrame, permission: str) -> DataFrame:
    """Users that hold a permission."""
    return users.where(F.col("role").isin(S.PERMISSION_ROLES[permission]))
