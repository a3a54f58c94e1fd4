"""Who may see what: joins with grants, consents and pledges; ``as_of`` stands where a clock would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rollout

# fixed values: the levels that imply a required one
LEVELS = ["emergency", "read_only", "read_write", "full_access", "owner"]
SENSITIVE = ("ai_processing", "narrative_data", "semantic_analysis")
#: About how many profiles of an owner meet as many others of theirs under one key.
BLOCK = 2048


def unexpired(until: Column, as_of: Column) -> Column:
    """No end, or one that lies ahead."""
    return until.isNull() | (until > as_of)


def valid_at(start: Column, until: Column, as_of: Column) -> Column:
    """Within an interval that may have no end."""
    return (as_of >= start) & (until.isNull() | (as_of <= until))


def live(archived: Column) -> Column:
    """Not archived; null counts as not archived (P07). Where null is to be left out, compare with false."""
    return ~F.coalesce(archived, F.lit(False))


def implies(level: Column, required: str) -> Column:
    """Whether a level implies a required one; an unknown required level is implied by none."""
    return level.isin(*LEVELS[LEVELS.index(required) :]) if required in LEVELS else F.lit(False)


def held_grants(grants: DataFrame, as_of: Column) -> DataFrame:
    """Grants that are neither over nor revoked."""
    return grants.where(unexpired(F.col("access_end"), as_of) & F.col("revoked_at").isNull())


def accessible_profiles(profiles: DataFrame, grants: DataFrame, as_of: Column, level: str = "emergency") -> DataFrame:
    """(user_id, profile_id, access_type) of all users: profiles they own and profiles granted to them at a level.

    ``profiles`` has profile_id, owner_id, archived; ``grants`` user_id, profile_id, level, access_end, revoked_at. A
    pair that is both owned and granted has a row for each.
    """
    open_profiles = profiles.where(F.col("archived") == F.lit(False))
    owned = open_profiles.select(F.col("owner_id").alias("user_id"), "profile_id", F.lit("owner").alias("access_type"))
    given = held_grants(grants, as_of).where(implies(F.col("level"), level)).select("user_id", "profile_id", F.col("level").alias("access_type"))
    return owned.unionByName(given.join(open_profiles.select("profile_id"), "profile_id", "left_semi"))


def secured(rows: DataFrame, access: DataFrame, user: int | str, owner: str, user_col: str = "user_id", profile_col: str = "profile_id") -> DataFrame:
    """Rows whose owner the user may see (R01): a semi join with the access that holds, which needs no distinct."""
    return rows.join(access.where(F.col(user_col) == user).select(F.col(profile_col).alias(owner)), owner, "left_semi")


def provider_access(asked: DataFrame, grants: DataFrame, as_of: Column) -> DataFrame:
    """Every question (provider_id, patient_id, resource) with granted and a reason where it is not.

    ``grants`` has grant_id, provider_id, patient_id, status, expires_at, scope (array) and pledged; of several that hold the
    smallest id decides.
    """
    open_grants = grants.where((F.col("status") == "active") & unexpired(F.col("expires_at"), as_of)).withColumn("resource", F.explode("scope"))
    first = open_grants.groupBy("provider_id", "patient_id", "resource").agg(F.min(F.struct("grant_id", "pledged", "expires_at")).alias("g"))
    pledged = F.coalesce(F.col("g.pledged"), F.lit(False))
    reason = F.when(F.col("g").isNull(), "no_active_permission").when(~pledged, "pledge_not_acknowledged")
    return asked.join(first, ["provider_id", "patient_id", "resource"], "left").select(*asked.columns, reason.isNull().alias("granted"),
        reason.alias("reason"), F.col("g.grant_id").alias("grant_id"))


def consented(asked: DataFrame, consents: DataFrame, as_of: Column, purpose: str = "healthcare_services") -> DataFrame:
    """Every question (patient_id, accessor_id, resource) with ``allowed``: a consent for that purpose holds, given to the
    accessor or to all, for the resource or for all (R05)."""
    held = consents.where((F.col("purpose") == purpose) & F.col("granted") & valid_at(F.col("valid_from"), F.col("valid_until"),
        as_of) & F.col("revoked_at").isNull())
    held = held.select("patient_id", F.col("granted_to").alias("_to"), F.col("resource_type").alias("_for")).distinct()
    n = held.groupBy("patient_id").agg(F.collect_set(F.struct("_to", "_for")).alias("_held"))  # who and what are few for a patient
    some = F.exists("_held",
        lambda h: (h["_to"].isNull() | (h["_to"] == F.col("accessor_id"))) & (h["_for"].isNull() | (h["_for"] == F.col("resource"))))
    return asked.join(n, "patient_id", "left").select(*asked.columns, F.coalesce(some, F.lit(False)).alias("allowed"))


def consent_status(granted: Column, start: Column, until: Column, revoked: Column, as_of: Column) -> Column:
    """Revoked, Expired, Active or Inactive."""
    return (
        F.when((granted == F.lit(False)) | revoked.isNotNull(), "Revoked").when(until < as_of, "Expired")
        .when(granted & valid_at(start, until, as_of), "Active").otherwise("Inactive")
    )


def semantic_access(asked: DataFrame, access: DataFrame, consents: DataFrame, providers: DataFrame, relations: DataFrame, as_of: Column) -> DataFrame:
    """Every question (user_id, profile_id, resource) with ``allowed``.

    Reading access is a must; sensitive resources also need a granted consent that is not over. Beyond these two a provider's own
    active relation changes nothing, as they come first; ``via_provider`` tells whether there is one.
    """
    basic = access.select("user_id", "profile_id").distinct().withColumn("_basic", F.lit(True))
    given = consents.where((F.col("consent_type") == "ai_processing") & (F.col("status") == "granted") & unexpired(F.col("expires_at"), as_of))
    given = given.select(F.col("patient_id").alias("profile_id")).distinct().withColumn("_consent", F.lit(True))
    active = relations.where((F.col("status") == "active") & F.col("consent_given")).join(providers.where("active").select("provider_id", "user_id"),
        "provider_id")
    active = active.select("user_id", F.col("patient_id").alias("profile_id")).distinct().withColumn("_provider", F.lit(True))
    rows = asked.join(basic, ["user_id", "profile_id"], "left").join(given, "profile_id", "left").join(active, ["user_id", "profile_id"], "left")
    is_set = lambda c: F.coalesce(c, F.lit(False))
    allowed = is_set("_basic") & (~F.col("resource").isin(*SENSITIVE) | is_set("_consent"))
    return rows.select(*asked.columns, allowed.alias("allowed"), is_set("_provider").alias("via_provider"))


def owner_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): every pair of a row of ``left`` and one of ``right`` with the same owner_id.

    The rows of an owner with more than BLOCK of them are dealt into bins by a hash of their id, and each bin meets each: no key gives more
    than about BLOCK * BLOCK pairs. Keys go to as many tasks as shuffles have whatever their bytes, as few rows give many pairs.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_owner = lambda df, name: df.groupBy("owner_id").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    large = by_owner(left, "_left").join(by_owner(right, "_right"), "owner_id").where("_left > 1 OR _right > 1")  # a row for BLOCK of the input at most
    bins = lambda c: F.coalesce(c, F.lit(1))

    def dealt(df: DataFrame, key: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        rows = df.select("owner_id", key).join(F.broadcast(large), "owner_id", "left")
        rows = rows.select("owner_id", key, F.pmod(F.xxhash64(key), bins(F.col(own))).alias(names[0]), F.explode(F.sequence(F.lit(1).cast("long"), bins(F.col(other)))).alias("_n"))
        return rows.withColumn(names[1], F.col("_n") - 1).repartition(n, "owner_id", "_i", "_j")

    one, two = dealt(left, a, "_left", "_right", ("_i", "_j")), dealt(right, b, "_right", "_left", ("_j", "_i"))
    return one.join(two.hint("merge"), ["owner_id", "_i", "_j"]).select(a, b)


def allowed_patients(profiles: DataFrame, as_of: Column) -> DataFrame:
    """(profile_id, patient_id, relationship, scope, valid_until): each profile itself, and its owner's other profiles of type
    self in an emergency (R07, J05). All pairs of an owner are the result, so it grows with the square of their profiles."""
    own = profiles.where(F.col("archived") == F.lit(False))
    full = own.select("profile_id", F.col("profile_id").alias("patient_id"), F.col("profile_type").alias("relationship"),
        F.lit("full").alias("scope"), F.add_months(as_of, 12).alias("valid_until"))
    selves = profiles.where("profile_type = 'self'").select(F.col("owner_id"), F.col("profile_id").alias("patient_id"))
    other = owner_pairs(own, selves, "profile_id", "patient_id").where("patient_id <> profile_id")
    emergency = other.select("profile_id", "patient_id", F.lit("emergency").alias("relationship"), F.lit("emergency").alias("scope"),
        F.add_months(as_of, 6).alias("valid_until"))
    return full.unionByName(emergency)


def feature_enabled(enabled: Column, users: Column, percent: int, user: Column) -> Column:
    """A feature is on for all, for a listed user, or for those that its rollout takes in."""
    listed = F.coalesce(F.array_contains(users, user), F.lit(False))
    return enabled | F.coalesce(listed | rollout(user, percent), F.lit(False))


def listed_user(users: Column, user: Column, on: bool) -> Column:
    """The users of a feature with one more, or without one."""
    return F.array_union(users, F.array(user)) if on else F.array_remove(users, user)


def expired_access(grants: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(grants with those that are over marked so, one row that counts them)."""
    over = (F.col("status") == "active") & (F.col("expires_at") < as_of)
    after = grants.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))
    return after, grants.agg(F.count_if(over).alias("expired"))


def given_consent(consents: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """Consents after new ones come in (N10): a new one is granted from now on, an old one that is given again is no longer
    revoked and has both evidences (JSON, the new one's fields win)."""
    key = ["patient_id", "consent_type"]
    both = consents.join(fresh.select(*key, F.col("evidence").alias("_fresh")), key, "full")
    old, new = F.from_json("evidence", "map<string,string>"), F.from_json("_fresh", "map<string,string>")
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    merged = F.to_json(F.map_concat(F.coalesce(kept, old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), new))
    hit = F.col("_fresh").isNotNull()
    return both.select(
        *key, F.when(hit, True).otherwise(F.col("granted")).alias("granted"), F.when(hit, as_of).otherwise(F.col("valid_from")).alias("valid_from"),
        F.when(hit, F.lit(None)).otherwise(F.col("revoked_at")).cast("timestamp_ntz").alias("revoked_at"),
            F.when(hit, merged).otherwise(F.col("evidence")).alias("evidence"),
    )
