"""Campaign audience selection and the append-only contact ledger.

The serving DB of the reference becomes Parquet tables; every request is a
batch job over them.  ``as_of`` is always passed in (never the wall clock),
so reruns are reproducible.  Writes go to a new version directory and a
pointer swap (see ``sources.tables.publish``); the ledger is append-only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapsekit.session import cut_lineage

# Purpose -> lifecycle status, action types, sortable columns.
PURPOSES = {"retention": "active", "renewal": "grace", "winback": "lapsed"}
ACTION_TYPES = ("reminder", "discount_offer")
SORTABLE = ("churn_proba", "ltv_approx")
SELF_PREFIX = "self:"
# What a self-claimed benefit is called in the ledger; callers may pass their own names.
BENEFIT_NAMES = {"concert_raffle": "concert ticket raffle", "annual_tier": "yearly loyalty benefit",
                 "renewal_reward": "renewal reward"}


@dataclass(frozen=True)
class AudienceSpec:
    purpose: str
    action_type: str
    risk_tier: str | None = None
    segment: str | None = None
    exclude_recent_days: int = 0
    selection_mode: str = "all_matching"      # all_matching | top_n | manual
    audience_limit: int | None = None
    sort_by: str = "churn_proba"
    manual_ids: tuple = field(default_factory=tuple)
    max_recipients: int | None = None         # a launch limit of the caller; none by default

    def __post_init__(self):
        if self.purpose not in PURPOSES:
            raise ValueError(f"unknown purpose {self.purpose}")
        if self.action_type not in ACTION_TYPES:
            raise ValueError(f"unknown action type {self.action_type}")
        if self.selection_mode not in ("all_matching", "top_n", "manual"):
            raise ValueError(f"unknown selection mode {self.selection_mode}")
        if self.exclude_recent_days < 0:
            raise ValueError("exclude_recent_days must be >= 0")
        if self.selection_mode == "top_n" and (self.audience_limit is None or self.audience_limit < 1):
            raise ValueError("top_n needs an audience_limit of at least 1")


def normalize_ids(ids: DataFrame, col: str = "raw_id", pos: str = "pos") -> DataFrame:
    """De-duplication of a manual id list: trim, drop empties, keep each id with
    its first position (``pos``). A list of any length is kept whole."""
    t = ids.select(F.trim(F.col(col)).alias("id"), pos).filter(F.col("id") != "")
    return t.groupBy("id").agg(F.min(pos).alias(pos))


def recent_contacts(ledger: DataFrame, action_type: str, days: int, as_of: dt.datetime) -> DataFrame:
    """Customers that got ``action_type`` within ``days`` before ``as_of``."""
    since = as_of - dt.timedelta(days=days)
    return ledger.filter((F.col("action_type") == action_type) & (F.col("sent_at") >= F.lit(since))) \
        .select("customer_id").distinct()


def audience(scores: DataFrame, ledger: DataFrame, spec: AudienceSpec, as_of: dt.datetime,
             manual: DataFrame | None = None) -> DataFrame:
    """B1/B2: scores flagged with ``recent`` (contacted recently with the same
    action type -> excluded) among the rows matching the spec conditions.

    The recent-contact set is a left-anti/semi join (J9) on the key; the manual
    list is a left-semi join (J10)."""
    m = scores.filter(F.col("lifecycle_status") == PURPOSES[spec.purpose])
    if spec.risk_tier:
        m = m.filter(F.col("risk_tier") == spec.risk_tier)
    if spec.segment:
        m = m.filter(F.col("segment") == spec.segment)
    if spec.selection_mode == "manual" and manual is not None:
        # ids are compared as text: one that no customer has matches nothing
        m = m.join(manual.select("id"), F.col("customer_id").cast("string") == F.col("id"), "left_semi")
    if spec.exclude_recent_days > 0:
        rc = recent_contacts(ledger, spec.action_type, spec.exclude_recent_days, as_of).withColumn("__recent", F.lit(True))
        m = m.join(rc, "customer_id", "left").withColumn("recent", F.coalesce("__recent", F.lit(False))).drop("__recent")
    else:
        m = m.withColumn("recent", F.lit(False))
    return m


def preview(flagged: DataFrame, spec: AudienceSpec, requested: DataFrame | None = None) -> DataFrame:
    """Requested / matched / excluded by condition / excluded recent /
    eligible / selected / launchable / warning, in one aggregate."""
    agg = flagged.agg(F.count(F.lit(1)).alias("matched_count"),
                      F.count_if(~F.col("recent")).alias("eligible_count"))
    if spec.selection_mode == "manual" and requested is not None:
        agg = agg.crossJoin(requested.agg(F.count(F.lit(1)).alias("requested_count")))
    else:
        agg = agg.withColumn("requested_count", F.col("matched_count"))
    sel = F.least(F.col("eligible_count"), F.lit(spec.audience_limit)) if spec.selection_mode == "top_n" \
        else F.col("eligible_count")
    exc_cond = F.greatest(F.col("requested_count") - F.col("matched_count"), F.lit(0)) \
        if spec.selection_mode == "manual" else F.lit(0).cast("long")
    return agg.select(
        "requested_count", "matched_count", exc_cond.alias("excluded_condition_count"),
        (F.col("matched_count") - F.col("eligible_count")).alias("excluded_recent_count"),
        "eligible_count", sel.cast("long").alias("selected_count"),
        ((sel > 0) & ~_over(sel, spec)).alias("launchable"),
        F.when(sel == 0, "no_eligible_customers").when(_over(sel, spec), "over_recipient_cap").alias("warning"))


def _over(selected: Column, spec: AudienceSpec) -> Column:
    return F.lit(False) if spec.max_recipients is None else selected > spec.max_recipients


def _order(spec: AudienceSpec) -> list[Column]:
    col = spec.sort_by if spec.sort_by in SORTABLE else "churn_proba"
    return [F.col(col).desc(), F.col("customer_id").asc()]


def preview_sample(flagged: DataFrame, spec: AudienceSpec, n: int = 10) -> DataFrame:
    """Top ``n`` eligible customers by the sort column."""
    return flagged.filter(~F.col("recent")).orderBy(*_order(spec)).limit(n)


def select_recipients(flagged: DataFrame, spec: AudienceSpec) -> DataFrame:
    """All eligible, or the top N by the sort column (the limit is the feature)."""
    e = flagged.filter(~F.col("recent"))
    if spec.selection_mode == "top_n":
        e = e.orderBy(*_order(spec)).limit(spec.audience_limit)
    return e


def campaign_id_for(request_key: str) -> int:
    import hashlib
    return int(hashlib.md5(request_key.encode()).hexdigest()[:12], 16)


def launch(recipients: DataFrame, campaigns: DataFrame, spec: AudienceSpec, request_key: str,
           name: str, as_of: dt.datetime, sent_by: str = "staff", counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Snapshot recipients, one ledger row per recipient and the campaign
    row with its filters and counts (``counts``: the row of ``preview``).
    Idempotent on ``request_key``: if a campaign with this key exists the three
    frames are empty (left anti on the key). More recipients than the caller's
    ``max_recipients``, if given, are refused.

    A ledger row's id is the 64-bit hash of (campaign, customer)."""
    if spec.max_recipients is not None and recipients.limit(spec.max_recipients + 1).count() > spec.max_recipients:
        raise ValueError(f"more than {spec.max_recipients} recipients")
    cid = campaign_id_for(request_key)
    spark = recipients.sparkSession
    req = spark.createDataFrame([(request_key,)], "request_key string")
    new = req.join(campaigns.select("request_key"), "request_key", "left_anti")
    rec = recipients.crossJoin(new).select(
        F.lit(cid).alias("campaign_id"), "customer_id", F.lit("treatment").alias("group_type"),
        F.col("churn_proba").alias("churn_proba_at_send"), F.col("segment").alias("segment_at_send"),
        F.col("lifecycle_status").alias("lifecycle_at_send"))
    actions = rec.select(
        F.xxhash64("campaign_id", "customer_id").alias("id"), "customer_id",
        F.col("campaign_id"), F.lit(spec.action_type).alias("action_type"), F.lit(False).alias("is_read"),
        F.lit(None).cast("string").alias("benefit_key"), F.lit(sent_by).alias("sent_by"),
        F.lit(as_of).alias("sent_at"))
    camp = rec.agg(F.count(F.lit(1)).alias("recipient_count")).crossJoin(new)
    if counts is not None:
        camp = camp.crossJoin(counts.select("matched_count", (F.col("excluded_condition_count") + F.col("excluded_recent_count"))
                                            .alias("excluded_count")))
    else:
        camp = camp.withColumns({"matched_count": F.lit(None).cast("long"), "excluded_count": F.lit(None).cast("long")})
    camp = camp.select(
        F.lit(cid).alias("id"), F.lit(name.strip()).alias("name"), "request_key", F.lit(spec.purpose).alias("purpose"),
        F.lit(spec.action_type).alias("action_type"), F.lit(PURPOSES[spec.purpose]).alias("lifecycle_status"),
        F.lit(spec.risk_tier).cast("string").alias("risk_tier"), F.lit(spec.segment).cast("string").alias("segment"),
        F.lit(spec.selection_mode).alias("selection_mode"), F.lit(spec.audience_limit).cast("long").alias("audience_limit"),
        F.lit(spec.exclude_recent_days).alias("exclude_recent_days"), "matched_count", "excluded_count", "recipient_count",
        F.lit("completed").alias("status"), F.lit(sent_by).alias("created_by"), F.lit(as_of).alias("created_at"))
    return {"campaigns": camp, "campaign_recipients": rec, "customer_actions": actions}


def search(scores: DataFrame, id_substring: str | None, filters: dict[str, str], page: int, size: int,
           order: Sequence[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Customer search; an id substring overrides the other filters.
    Returns (page rows, total count frame)."""
    if id_substring:
        m = scores.filter(F.col("customer_id").cast("string").contains(id_substring.strip()))
    else:
        m = scores
        for k, v in filters.items():
            if v:
                m = m.filter(F.col(k) == v)
    order = order or [F.col("churn_proba").desc(), F.col("customer_id").asc()]
    return m.orderBy(*order).offset((page - 1) * size).limit(size), m.agg(F.count(F.lit(1)).alias("total"))


def overview(scores: DataFrame, ledger: DataFrame, campaigns: DataFrame) -> DataFrame:
    """KPI counts in one pass per table, combined to one row."""
    a = scores.agg(F.count(F.lit(1)).alias("customers"),
                   F.count_if(F.col("risk_tier") == "high_risk").alias("high_risk"),
                   F.count_if(F.col("lifecycle_status") == "active").alias("active"),
                   F.count_if(F.col("lifecycle_status") == "grace").alias("grace"),
                   F.count_if(F.col("lifecycle_status") == "lapsed").alias("lapsed"),
                   F.bround(F.avg("churn_proba"), 6).alias("avg_churn_proba"))
    b = ledger.agg(F.count(F.lit(1)).alias("actions"), F.count_distinct("customer_id").alias("contacted_customers"))
    c = campaigns.agg(F.count(F.lit(1)).alias("campaigns"))
    return a.crossJoin(b).crossJoin(c)


def contact_summary(ledger: DataFrame, scores: DataFrame, campaigns: DataFrame, latest: int = 10) -> dict[str, DataFrame]:
    """Total, by action type, by segment (ledger x scores inner, largest first), and the
    latest rows of scored customers with their campaign's name (left join) and segment."""
    j = ledger.join(scores.select("customer_id", "segment"), "customer_id", "inner")
    names = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    newest = j.orderBy(F.col("sent_at").desc(), F.col("id").desc()).limit(latest)
    return {
        "total": ledger.agg(F.count(F.lit(1)).alias("total")),
        "by_type": ledger.groupBy("action_type").agg(F.count(F.lit(1)).alias("actions")).orderBy(F.desc("actions"), "action_type"),
        "by_segment": j.groupBy("segment").agg(F.count(F.lit(1)).alias("actions")).orderBy(F.desc("actions"), "segment"),
        "latest": newest.join(names, "campaign_id", "left").orderBy(F.col("sent_at").desc(), F.col("id").desc()),
    }


def inbox(ledger: DataFrame, n: int = 20, customers: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` messages per customer (row_number partitioned by customer)."""
    l = ledger if customers is None else ledger.join(customers.select("customer_id"), "customer_id", "left_semi")
    w = Window.partitionBy("customer_id").orderBy(F.col("sent_at").desc(), F.col("id").desc())
    return l.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def apply_reads(ledger: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk read marks.  ``reads`` has (customer_id, id) where a NULL id
    means "all unread of that customer"; a message is marked only for its owner.
    Returns (new ledger, updated count)."""
    one = reads.filter(F.col("id").isNotNull()).select("id", "customer_id", F.lit(True).alias("__r1")).distinct()
    all_ = reads.filter(F.col("id").isNull()).select("customer_id", F.lit(True).alias("__r2")).distinct()
    j = ledger.join(one, ["id", "customer_id"], "left").join(all_, "customer_id", "left")
    hit = (F.coalesce("__r1", F.lit(False)) | F.coalesce("__r2", F.lit(False)))
    upd = j.withColumn("__upd", hit & ~F.col("is_read"))
    new = upd.withColumn("is_read", F.col("is_read") | hit).drop("__r1", "__r2", "__upd")
    return new.select(*ledger.columns), upd.agg(F.count_if("__upd").alias("updated"))


def claim_benefits(ledger: DataFrame, claims: DataFrame, names: dict[str, str] = BENEFIT_NAMES) -> DataFrame:
    """One claim per (customer, benefit): earliest request wins and
    already-claimed benefits are ignored (anti join vs the ledger).  New ledger
    rows are read already and carry ``sent_by = 'self:<benefit name>'`` (the key
    itself if it has no name)."""
    w = Window.partitionBy("customer_id", "benefit_key").orderBy(F.col("claimed_at").asc(), F.col("claim_id").asc())
    first = claims.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    have = ledger.filter(F.col("benefit_key").isNotNull()).select("customer_id", "benefit_key")
    new = first.join(have, ["customer_id", "benefit_key"], "left_anti")
    name = F.col("benefit_key")
    for key, text in names.items():
        name = F.when(F.col("benefit_key") == key, F.lit(text)).otherwise(name)
    return new.select(F.col("claim_id").alias("id"), "customer_id", F.lit(None).cast("long").alias("campaign_id"),
                      F.lit("discount_offer").alias("action_type"), F.lit(True).alias("is_read"), "benefit_key",
                      F.concat(F.lit(SELF_PREFIX), name).alias("sent_by"), F.col("claimed_at").alias("sent_at"))


def single_actions(requests: DataFrame, scores: DataFrame, as_of: dt.datetime, sent_by: str = "staff") -> DataFrame:
    """Action rows for requests whose customer exists (semi join), batch form."""
    ok = requests.join(scores.select("customer_id"), "customer_id", "left_semi")
    return ok.select(F.col("request_id").alias("id"), "customer_id", F.lit(None).cast("long").alias("campaign_id"),
                     "action_type", F.lit(False).alias("is_read"), F.lit(None).cast("string").alias("benefit_key"),
                     F.lit(sent_by).alias("sent_by"), F.lit(as_of).alias("sent_at"))


def evolve(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Union of tables with different column sets; missing columns get defaults."""
    u = old.unionByName(new, allowMissingColumns=True)
    return u.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in u.columns})


# --------------------------------------------------------------------- B6, B7, B16 by commits
CAMPAIGN_SCHEMA = ("id long, name string, request_key string, purpose string, action_type string, lifecycle_status string, risk_tier string, "
                   "segment string, selection_mode string, audience_limit long, exclude_recent_days int, matched_count long, "
                   "excluded_count long, recipient_count long, status string, created_by string, created_at timestamp")
RECIPIENT_SCHEMA = ("campaign_id long, customer_id string, group_type string, churn_proba_at_send double, segment_at_send string, "
                    "lifecycle_at_send string")
ACTION_SCHEMA = ("id long, customer_id string, campaign_id long, action_type string, is_read boolean, benefit_key string, sent_by string, "
                 "sent_at timestamp")


def _as(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split(" ") for f in schema.split(", "))])


def _one_per(df: DataFrame, keys: list[str], what: str) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} must be unique")


def launch_committed(store, scores: DataFrame, spec: AudienceSpec, request_key: str, name: str, as_of: dt.datetime,
                     sent_by: str = "staff", manual: DataFrame | None = None):
    """Campaign, recipients and ledger rows in one commit of a ``TableStore``, chosen against the ledger of the
    version they are committed on.

    A request key that has a campaign commits nothing, whoever launched it and however many launches run at once. Campaign
    and ledger ids come from the store's counters, so they are unique; a recipient is unique in its campaign. If
    anything fails before the commit, none of the three tables changes. Returns the snapshot that holds the campaign.
    """
    from lapsekit.sources.store import Change

    def build(base):
        campaigns = store.read("campaigns", CAMPAIGN_SCHEMA, base)
        if not campaigns.filter(F.col("request_key") == request_key).isEmpty():
            return None
        flagged = audience(scores, store.read("customer_actions", ACTION_SCHEMA, base), spec, as_of, manual=manual)
        chosen = cut_lineage(select_recipients(flagged, spec))  # the same rows in all three tables
        _one_per(chosen, ["customer_id"], "recipients")
        out = launch(chosen, campaigns, spec, request_key, name, as_of, sent_by, preview(flagged, spec, requested=manual))
        campaign_id = int(base.properties.get("next_campaign_id", 1))
        actions, ids = store.numbered(out["customer_actions"].drop("id"), "customer_id", base, "id", "next_action_id")
        own = {"campaigns": out["campaigns"].withColumn("id", F.lit(campaign_id)),
               "campaign_recipients": out["campaign_recipients"].withColumn("campaign_id", F.lit(campaign_id)),
               "customer_actions": actions.withColumn("campaign_id", F.lit(campaign_id))}
        schemas = {"campaigns": CAMPAIGN_SCHEMA, "campaign_recipients": RECIPIENT_SCHEMA, "customer_actions": ACTION_SCHEMA}
        return Change(add={t: _as(df, schemas[t]) for t, df in own.items()}, properties={"next_campaign_id": campaign_id + 1, **ids})

    return store.transact(build)


def claim_committed(store, claims: DataFrame, names: dict[str, str] = BENEFIT_NAMES):
    """``claim_benefits`` against the ledger of the version it is committed on, with ids from the store's counter; of
    two claims of one benefit by one customer, in whatever commits, one gets a row."""
    from lapsekit.sources.store import Change

    def build(base):
        ledger = store.read("customer_actions", ACTION_SCHEMA, base)
        new = cut_lineage(claim_benefits(ledger, claims, names))
        if new.isEmpty():
            return None
        new = new.withColumn("__key", F.concat_ws("\u0000", "customer_id", "benefit_key"))
        rows, ids = store.numbered(new.drop("id"), "__key", base, "id", "next_action_id")
        return Change(add={"customer_actions": _as(rows, ACTION_SCHEMA)}, properties=ids)

    return store.transact(build)
