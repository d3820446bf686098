"""Roles, permissions, applications, invites and account claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles from low to high, and the least role of each permission.
ROLES = ("guest", "reviewer", "editor", "admin", "superadmin")
PERMISSIONS = {
    "read": "guest",
    "suggest": "guest",
    "approve_text": "editor",
    "reopen": "admin",
    "manage_users": "admin",
    "manage_books": "admin",
    "view_stats": "admin",
    "grant_superadmin": "superadmin",
}
GATED = ("new", "pending", "declined", "rejected")


def rank(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), role).cast("int") - 1


def permission_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PERMISSIONS.items()), "permission string, min_role string")


def effective_role() -> Column:
    """The role whose permissions a user has: null for banned, read-only as 'none' for inactive, guest while gated."""
    return F.when(F.col("banned"), F.lit(None)).when(~F.col("active"), "none").when(F.col("application_status").isin(*GATED), "guest").otherwise(F.col("role"))


def granted(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """(id, permission) pairs: a match of ranks by inequality with the table of permissions, eight rows."""
    rows = users.select("id", effective_role().alias("level"))
    least = permissions.select("permission", rank(F.col("min_role")).alias("least"))
    ok = F.when(F.col("level") == "none", F.col("permission") == "read").otherwise(rank(F.col("level")) >= F.col("least"))
    return rows.join(F.broadcast(least), ok).select("id", "permission")


def found(users: DataFrame, q: str = "", role: str = "") -> DataFrame:
    """Users but guests whose name or email contains q in any case, of the given role."""
    out = users.where("role <> 'guest'")
    if q.strip():
        low = F.lit(q.strip().lower())
        out = out.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), low) | F.contains(F.lower(F.coalesce("email", F.lit(""))), low))
    return out.where(F.col("role") == role) if role else out


def pending_applications(users: DataFrame) -> DataFrame:
    return users.where("application_status = 'pending'")


def applied(commands: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome of role changes (actor_id, target_id, new_role): nobody changes themselves, superadmin takes a superadmin on
    either side, and a direct change approves an application unless it is unset."""
    actor = users.select(F.col("id").alias("actor_id"), rank(F.col("role")).alias("actor_rank"))
    target = users.select(F.col("id").alias("target_id"), F.col("role").alias("old_role"), "application_status")
    rows = commands.join(actor, "actor_id").join(target, "target_id")
    top = ROLES.index("superadmin")
    bad = (
        F.when(F.col("actor_rank") < ROLES.index("admin"), "forbidden")
        .when(F.col("actor_id") == F.col("target_id"), "own account")
        .when(F.col("new_role") == "guest", "invalid role")
        .when(((F.col("new_role") == "superadmin") | (F.col("old_role") == "superadmin")) & (F.col("actor_rank") < top), "needs superadmin")
    )
    return rows.select("actor_id", "target_id", F.coalesce(bad, F.lit("ok")).alias("outcome"), F.when(bad.isNull(), F.col("new_role")).otherwise(F.col("old_role")).alias("role"), F.when(bad.isNull() & (F.col("application_status") != "unset"), "approved").otherwise(F.col("application_status")).alias("application_status"))


def first_seen(rows: DataFrame, email: str, order: list[str]) -> DataFrame:
    """One row per email in lower case, the first spelling by order."""
    key = F.lower(F.trim(F.col(email)))
    rest = [c for c in rows.columns]
    return rows.groupBy(key.alias("email_key")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("email_key", "r.*")


def claimed(signins: DataFrame, users: DataFrame, invites: DataFrame) -> DataFrame:
    """Accounts after first sign-ins (uid, email): a pending:<email> placeholder is taken over with its role, an invite gives
    its role once, others are new reviewers."""
    held = users.where(F.startswith("uid", F.lit("pending:"))).select(F.lower(F.trim("email")).alias("k"), F.col("id").alias("old_id"), F.col("role").alias("held_role"))
    asked = invites.select(F.lower(F.trim("email")).alias("k"), F.col("role").alias("invited_role"))
    rows = signins.withColumn("k", F.lower(F.trim("email"))).join(held, "k", "left").join(asked, "k", "left")
    return rows.select("uid", F.col("k").alias("email"), "old_id", F.coalesce("invited_role", "held_role", F.lit("reviewer")).alias("role"), F.when(F.col("old_id").isNotNull(), "claimed").when(F.col("invited_role").isNotNull(), "invited").otherwise("new").alias("outcome"))


def stale(seconds_since: Column, least: int = 60) -> Column:
    """Whether a last-seen time is due for an update: never seen, or longer ago than least."""
    return F.coalesce(seconds_since > least, F.lit(True))


def guest_id_ok(guest: Column) -> Column:
    plain = F.replace(guest, F.lit("-"))
    return F.coalesce((F.length(guest) <= 64) & F.rlike(plain, F.lit(r"^(?U)\w+$")) & ~F.contains(plain, F.lit("_")), F.lit(False))
