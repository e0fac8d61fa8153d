"""Audit log, login lockout, compliance report and access review."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.timefx import as_of_or_latest, seconds_after, seconds_before
from logspark.operators.metrics import count_if
from logspark.operators.ordered import running, time_chunk
from logspark.schema import literal_table

# Default roles and their permissions.
DEFAULT_ROLES = {
    "super-admin": ["*"],
    "admin": [
        "logs:read", "logs:write", "logs:delete", "alerts:read", "alerts:write", "alerts:delete", "users:read", "users:write",
        "config:read", "config:write", "dashboards:read", "dashboards:write", "integrations:read", "integrations:write",
    ],
    "analyst": ["logs:read", "logs:search", "alerts:read", "alerts:acknowledge", "dashboards:read", "topology:read", "anomalies:read"],
    "operator": ["logs:read", "alerts:read", "alerts:acknowledge", "dashboards:read", "health:read"],
    "viewer": ["logs:read", "alerts:read", "dashboards:read"],
}
# Lockout rule and report period.
LOCK_AFTER = 5
LOCK_SECONDS = 30 * 60
REPORT_DAYS = 30
LOGIN_ADVICE = "High failed login rate detected - consider implementing additional security measures"
LOCKOUT_ADVICE = "Account lockouts detected - review user training and password policies"


def default_roles(spark: SparkSession) -> DataFrame:
    return literal_table(spark, DEFAULT_ROLES.items(), "role STRING, permissions ARRAY<STRING>")


def audit_log(audit: DataFrame, *, action: str | None = None, actor: str | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Filtered audit events, newest first; the date range is closed."""
    out = audit
    if action is not None:
        out = out.where(F.col("action") == action)
    if actor is not None:
        out = out.where(F.col("actor") == actor)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end))
    return out.orderBy(F.col("timestamp").desc(), "event_id")


def lockouts(audit: DataFrame, *, tie: str = "event_id", chunk_seconds: int = 3600) -> DataFrame:
    """Failed logins that lock the account: the fifth and later wrong password since the last success.

    Unknown users and attempts on a locked account do not count. The failures since the last
    success are the running total minus the total at that success.
    """
    wrong = ((F.col("action") == "auth.failed") & (F.col("reason") == "invalid_password")).cast("bigint")
    logins = audit.where(F.col("action").isin("auth.success", "auth.failed")).select(
        "actor", "timestamp", tie, "action", F.coalesce(wrong, F.lit(0)).cast("bigint").alias("__wrong")
    )
    chunked = logins.withColumn("__chunk", time_chunk(F.col("timestamp"), chunk_seconds))
    order = ["timestamp", tie]
    total = running(chunked, ["actor"], "__chunk", order, {"__total": ("sum", F.col("__wrong"))})
    at_success = F.when(F.col("action") == "auth.success", F.col("__total"))
    since = running(total, ["actor"], "__chunk", order, {"__base": ("max", at_success)})
    attempts = F.col("__total") - F.coalesce("__base", F.lit(0))
    return (
        since.withColumn("attempts", attempts)
        .where((F.col("__wrong") == 1) & (F.col("attempts") >= LOCK_AFTER))
        .select("actor", "timestamp", tie, "attempts", seconds_after(F.col("timestamp"), LOCK_SECONDS).alias("locked_until"))
    )


def compliance_report(audit: DataFrame, users: DataFrame, roles: DataFrame, *, as_of: Any = None, days: int = REPORT_DAYS) -> DataFrame:
    """One row: users, roles, activity and security events of the period, and advice."""
    now = as_of_or_latest(audit, "timestamp", as_of)
    action = lambda name: count_if(F.col("action") == name).alias(name.replace(".", "_"))
    figures = audit.where(F.col("timestamp") >= seconds_before(now, days * 86400)).agg(
        F.count(F.lit(1)).alias("audit_entries"),
        action("auth.success"), action("auth.failed"), action("access.denied"),
        count_if(F.col("reason") == "account_locked").alias("account_lockouts"),
        action("pii.detected"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("auth_failed") > F.col("auth_success") * 0.1, F.lit(LOGIN_ADVICE)),
            F.when(F.col("account_lockouts") > 0, F.lit(LOCKOUT_ADVICE)),
        )
    )
    people = users.select("user_name", "is_active").groupBy("user_name").agg(F.max("is_active").alias("is_active"))
    return figures.select(
        people.agg(F.count(F.lit(1))).scalar().alias("total_users"),
        people.agg(count_if(F.col("is_active"))).scalar().alias("active_users"),
        roles.agg(F.count(F.lit(1))).scalar().alias("total_roles"),
        "audit_entries",
        F.col("auth_success").alias("logins"),
        F.col("auth_failed").alias("failed_logins"),
        F.col("access_denied").alias("access_denials"),
        "account_lockouts",
        F.col("pii_detected").alias("pii_detections"),
        F.array_join(advice, "; ").alias("recommendations"),
    )


def user_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct permissions per user."""
    return users.join(roles, "role").select("user_name", F.explode("permissions").alias("permission")).distinct()


def access_review(requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests ``(user_name, permission)`` with ``granted``: exact, ``*`` or ``namespace:*`` permission of any role.

    A request is checked against the few permissions of each role it meets; grants are not joined
    pair by pair.
    """
    need = F.col("permission")
    covers = lambda p: (p == "*") | (p == need) | (p.endswith(":*") & need.startswith(F.substring(p, F.lit(1), F.length(p) - 1)))
    met = requests.distinct().join(users.select("user_name", "role"), "user_name", "left").join(roles, "role", "left")
    granted = F.coalesce(F.exists("permissions", covers), F.lit(False))
    return met.groupBy("user_name", "permission").agg(F.max(granted).alias("granted"))
