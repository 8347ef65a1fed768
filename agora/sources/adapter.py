"""Domain tables derived from the general-purpose test tables.

Every mapping is a row-wise projection (plus, for votes, the filter on vote events), so
the scans stay prunable and the derived tables grow with the given ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agora import session
from agora.operators import ideas as idea_jobs
from agora.operators import votes as vote_jobs

AS_OF = "2024-01-31 00:00:00"


def _pick(key: Column, choices: dict[object, str], default: str | None = None) -> Column:
    out = None
    for value, name in choices.items():
        out = F.when(key == value, name) if out is None else out.when(key == value, name)
    return out.otherwise(F.lit(default))


class GivenTables:
    """The parquet tables of one folder, and the domain tables mapped from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = session.prepare(spark)
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def votes(self) -> DataFrame:
        return votes_from_events(self.events)

    @cached_property
    def vote_events(self) -> DataFrame:
        """Votes in the shape of the vote topic; some withdraw or edit an earlier vote."""
        kind = F.when(F.col("vote_id") % 11 == 0, "vote_removed").when(
            F.col("vote_id") % 11 == 1, "vote_updated"
        )
        return self.votes.select(
            F.col("vote_id").cast("string").alias("event_id"),
            kind.otherwise("vote_cast").alias("event_type"),
            "idea_id",
            "user_id",
            "vote_type",
            "rating",
            F.col("created_at").alias("timestamp"),
            "ip_address",
            "user_agent",
        )

    @cached_property
    def large_votes(self) -> DataFrame:
        """Votes from the largest table: parts are ideas, suppliers are voters."""
        line = self.raw("lineitem")
        kind = _pick(F.col("l_returnflag"), {"A": "upvote", "R": "downvote", "N": "rating"})
        return line.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vote_id"),
            F.col("l_partkey").cast("int").alias("idea_id"),
            F.col("l_suppkey").cast("string").alias("user_id"),
            kind.alias("vote_type"),
            F.when(F.col("l_returnflag") == "N", 1.0 + (F.col("l_quantity") % 9) * 0.5).alias("rating"),
            F.concat(F.lit("10.0."), (F.col("l_suppkey") % 7).cast("string"), F.lit(".1")).alias("ip_address"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def ideas(self) -> DataFrame:
        """Ideas without vote totals; see :attr:`rated_ideas`."""
        docs = self.raw("documents")
        created = F.make_timestamp(
            F.lit(2024), F.lit(1), (F.col("doc_id") % 30 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)
        ) + F.make_dt_interval(hours=(F.col("doc_id") % 24).cast("int"), mins=(F.col("doc_id") % 60).cast("int"))
        status = _pick(
            F.col("doc_id") % 5,
            {0: "draft", 1: "published", 2: "under_review", 3: "implemented", 4: "rejected"},
        )
        return (
            docs.select(
                F.col("doc_id").cast("int").alias("idea_id"),
                F.substring_index("text", "\n", 1).alias("title"),
                F.col("text").alias("description"),
                _pick(
                    F.col("lang"),
                    {"en": "innovation", "fr": "improvement", "de": "cost_saving"},
                    "other",
                ).alias("category"),
                status.alias("status"),
                (F.col("doc_id") % 160).cast("string").alias("user_id"),
                F.concat(F.lit("user_"), (F.col("doc_id") % 160).cast("string")).alias("user_name"),
                F.col("n_chars").alias("view_count"),
                F.array("lang", "source").alias("tags"),
                created.alias("created_at"),
            )
            .withColumn(
                "published_at",
                F.when(F.col("status") != "draft", F.col("created_at") + F.expr("INTERVAL 1 DAY")),
            )
        )

    @cached_property
    def rated_ideas(self) -> DataFrame:
        """Ideas with the vote totals synchronised back to them."""
        return idea_jobs.sync_vote_totals(self.ideas, self.votes)

    @cached_property
    def comments(self) -> DataFrame:
        talk = self.raw("conversations")
        created = F.make_timestamp(
            F.lit(2024), F.lit(1), (F.col("conv_id") % 30 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)
        ) + F.make_dt_interval(mins=F.col("turn").cast("int"))
        return talk.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
            F.col("conv_id").cast("int").alias("idea_id"),
            (F.col("turn") % 15).cast("string").alias("user_id"),
            F.col("text").alias("content"),
            ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("is_deleted"),
            created.alias("created_at"),
        )

    @cached_property
    def interactions(self) -> DataFrame:
        """Interactions under spellings the ETL has to repair."""
        kind = _pick(
            F.col("event_type"),
            {"view": " View", "click": "Like ", "signup": "CREATE", "purchase": "share", "error": "delete"},
        )
        return self.events.select(
            "event_id",
            F.col("user_id").cast("string").alias("user_id"),
            F.col("ts").alias("timestamp"),
            kind.alias("interaction_type"),
            F.get_json_object("props", "$.k").alias("content_id"),
            F.col("ts").alias("session_start"),
            (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("session_end"),
            F.col("value").alias("engagement_score"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.initcap("event_type").alias("metric_name"),
            F.col("value").alias("metric_value"),
            F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("component"),
            F.col("ts").alias("timestamp"),
        )

    @cached_property
    def system_metrics(self) -> DataFrame:
        """Metrics under the names that have alert thresholds."""
        name = _pick(
            F.col("event_type"),
            {
                "view": "throughput",
                "click": "cpu_usage",
                "signup": "memory_usage",
                "purchase": "response_time",
                "error": "error_rate",
            },
        )
        scale = F.when(F.col("event_type") == "purchase", F.lit(20.0)).otherwise(F.lit(1.0))
        return self.events.select(
            "event_id",
            name.alias("metric_name"),
            (F.col("value") * scale).alias("metric_value"),
            F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("component"),
            F.col("ts").alias("timestamp"),
        )

    @cached_property
    def thoughts(self) -> DataFrame:
        docs = self.raw("documents")
        created = F.make_timestamp(
            F.lit(2024), F.lit(1), (F.col("doc_id") % 30 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)
        ) + F.make_dt_interval(hours=(F.col("doc_id") % 24).cast("int"), mins=(F.col("doc_id") % 60).cast("int"))
        tags = F.when(
            F.col("doc_id") % 10 != 0,
            F.array(
                F.concat(F.lit(" "), F.upper("lang")),
                F.col("source"),
                F.when(F.col("doc_id") % 3 == 0, "personal").otherwise("not valid!"),
            ),
        )
        return docs.select(
            F.col("doc_id").alias("thought_id"),
            (F.col("doc_id") % 160).cast("string").alias("user_id"),
            F.col("text").alias("thought_text"),
            F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 25 - 12) / F.lit(10.0)).alias("sentiment_score"),
            tags.alias("tags"),
            created.alias("timestamp"),
        )

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.events.where(F.col("event_type") == "view").select(
            F.col("user_id").cast("string").alias("user_id"),
            F.concat(F.lit("algo_"), (F.col("user_id") % 4).cast("string")).alias("algorithm"),
            ((F.col("event_id") % 120) / F.lit(100.0)).alias("confidence_score"),
            F.array_repeat(F.get_json_object("props", "$.k"), (F.col("event_id") % 60).cast("int")).alias(
                "recommended_content"
            ),
            F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("double")).alias("feedback_score"),
            F.col("ts").alias("timestamp"),
            "event_id",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        orders = self.raw("orders")
        status = _pick(F.col("o_orderstatus"), {"P": "pending", "O": "approved", "F": "implemented"})
        kind = _pick(
            F.col("o_orderpriority"),
            {
                "1-URGENT": "implementation",
                "2-HIGH": "escalation",
                "3-MEDIUM": "modification",
                "4-NOT SPECIFIED": "deferral",
                "5-LOW": "rejection",
            },
        )
        created = F.col("o_orderdate").cast("timestamp")
        decided = F.when(
            F.col("o_orderstatus") != "P",
            created + F.make_dt_interval(days=(F.col("o_orderkey") % 40 + 1).cast("int")),
        )
        return (
            orders.select(
                F.col("o_orderkey").alias("id"),
                F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("decision_id"),
                (F.col("o_orderkey") % 200).cast("int").alias("idea_id"),
                kind.alias("decision_type"),
                status.alias("status"),
                F.col("o_custkey").cast("string").alias("decided_by"),
                F.concat(F.lit("Decision on idea "), (F.col("o_orderkey") % 200).cast("string")).alias("summary"),
                F.concat(F.lit("priority "), F.col("o_orderpriority")).alias("rationale"),
                (F.col("o_orderkey") % 120).cast("int").alias("timeline_days"),
                F.col("o_totalprice").alias("estimated_cost"),
                (F.col("o_totalprice") * (F.col("o_custkey") % 7) / F.lit(3.0)).alias("estimated_revenue"),
                F.array_repeat(F.lit("risk"), (F.col("o_orderkey") % 5).cast("int")).alias("risk_factors"),
                ((F.col("o_custkey") % 100) / F.lit(100.0)).alias("success_probability"),
                created.alias("created_at"),
                decided.alias("decided_at"),
            )
            .withColumn(
                "implemented_at",
                F.when(
                    F.col("status") == "implemented",
                    F.col("decided_at") + F.make_dt_interval(days=(F.col("id") % 60 + 5).cast("int")),
                ),
            )
        )

    @cached_property
    def decision_events(self) -> DataFrame:
        line = self.raw("lineitem")
        number, flag, state = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
        kind = _pick(
            number,
            {
                1: "decision_created",
                2: "status_changed",
                3: "metrics_snapshot_taken",
                4: "committee_assigned",
                5: "implementation_plan_updated",
                6: "status_changed",
            },
            "conditions_updated",
        )
        new_status = F.concat(flag, state)
        new_status = _pick(
            new_status,
            {"AF": "approved", "AO": "in_review", "RF": "rejected", "RO": "pending", "NF": "implemented"},
            "on_hold",
        )
        data = (
            F.when(kind == "status_changed", F.to_json(F.struct(new_status.alias("new_status"))))
            .when(
                kind == "metrics_snapshot_taken",
                F.to_json(F.struct(F.struct(F.col("l_partkey").alias("views")).alias("metrics"))),
            )
            .when(
                kind == "committee_assigned",
                F.to_json(
                    F.struct(
                        F.array(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias(
                            "committee"
                        )
                    )
                ),
            )
            .when(
                kind == "implementation_plan_updated",
                F.to_json(F.struct(F.concat(F.lit("plan "), F.col("l_partkey").cast("string")).alias("plan"))),
            )
            .when(
                kind == "conditions_updated",
                F.to_json(F.struct(F.array(F.concat(F.lit("c"), flag)).alias("conditions"))),
            )
            .otherwise(F.to_json(F.struct(F.lit("pending").alias("initial_status"))))
        )
        return line.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
            F.col("l_orderkey").alias("decision_id"),
            kind.alias("event_type"),
            data.alias("event_data"),
            F.col("l_suppkey").cast("string").alias("actor_id"),
            F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("Actor "), F.col("l_suppkey").cast("string"))).alias(
                "actor_name"
            ),
            F.when(F.col("l_suppkey") % 2 == 0, "approver").alias("actor_role"),
            F.col("l_shipdate").cast("timestamp").alias("occurred_at"),
            # Order of events that share a timestamp.
            (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias(
                "sequence"
            ),
        )

    @cached_property
    def committee_votes(self) -> DataFrame:
        line = self.raw("lineitem")
        return line.select(
            F.col("l_orderkey").alias("decision_id"),
            F.col("l_suppkey").cast("string").alias("member_id"),
            _pick(F.col("l_returnflag"), {"A": "approve", "R": "reject", "N": "modify"}).alias("vote"),
            F.when(F.col("l_linenumber") == 1, 1.5).otherwise(1.0).alias("weight"),
        )

    @cached_property
    def users(self) -> DataFrame:
        """Accounts: one per voter of the events table."""
        return self.events.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
            F.max("ts").alias("last_event")
        )

    @cached_property
    def organizations(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("name")
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_nationkey").alias("organization_id"), F.col("c_custkey").cast("string").alias("user_id")
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """Decision sessions of organisations."""
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("session_id"), F.col("s_nationkey").alias("organization_id")
        )

    @cached_property
    def organization_ideas(self) -> DataFrame:
        return self.ideas.withColumn("organization_id", F.col("idea_id") % 25)

    @cached_property
    def criteria(self) -> DataFrame:
        """Decision criteria, one per nation: a configuration table of fixed size."""
        key = F.col("n_nationkey")
        return self.raw("nation").select(
            key.alias("criteria_id"),
            F.concat(F.lit("rule "), F.col("n_name")).alias("name"),
            _pick(key % 3, {0: "innovation", 1: "improvement"}, "cost_saving").alias("category"),
            (key * 3).alias("min_vote_count"),
            (key * 4).cast("double").alias("min_engagement_score"),
            (F.lit(1.0) + (key % 9) * 0.5).alias("min_average_rating"),
            ((key % 10) / F.lit(10.0)).alias("max_controversy_score"),
            (key % 5).alias("min_days_since_created"),
            ((key % 7) / F.lit(10.0)).alias("min_success_probability"),
            _pick(key % 4, {0: "implementation", 1: "modification", 2: "escalation"}, "rejection").alias(
                "suggested_decision_type"
            ),
            (key % 2 == 0).alias("auto_approve"),
            (key % 6 != 5).alias("is_active"),
        )

    @cached_property
    def templates(self) -> DataFrame:
        """Decision templates, one per region."""
        key = F.col("r_regionkey")
        kind = _pick(
            key,
            {0: "implementation", 1: "escalation", 2: "modification", 3: "deferral"},
            "rejection",
        )
        return self.raw("region").select(
            F.col("r_name").alias("template"),
            kind.alias("decision_type"),
            F.concat(F.lit("Template "), F.col("r_name")).alias("summary_template"),
            F.concat(F.lit("Standard rationale "), F.col("r_name")).alias("rationale_template"),
            (key * 10 + 30).alias("default_timeline_days"),
        )

    @cached_property
    def content(self) -> DataFrame:
        pages = self.raw("pages")
        title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
        return pages.select(
            F.col("page_id").cast("string").alias("content_id"),
            title.alias("title"),
            F.col("html").alias("description"),
            F.col("url"),
            F.length("html").cast("long").alias("view_count"),
            F.lit(0).cast("long").alias("like_count"),
        )


def votes_from_events(events: DataFrame) -> DataFrame:
    """Click, error and purchase events as up-, down- and rating votes (batch or stream)."""
    kind = _pick(F.col("event_type"), {"click": "upvote", "error": "downvote", "purchase": "rating"})
    return events.where(F.col("event_type").isin("click", "error", "purchase")).select(
        F.col("event_id").alias("vote_id"),
        F.get_json_object("props", "$.k").cast("int").alias("idea_id"),
        F.col("user_id").cast("string").alias("user_id"),
        kind.alias("vote_type"),
        F.when(F.col("event_type") == "purchase", 1.0 + (F.col("event_id") % 9) * 0.5).alias("rating"),
        F.concat(F.lit("10.0."), (F.col("event_id") % 7).cast("string"), F.lit(".1")).alias("ip_address"),
        F.lit("test agent").alias("user_agent"),
        F.col("ts").alias("created_at"),
    )
