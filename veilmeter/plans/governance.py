"""Classification, policy, provenance, data-subject, retention and registry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import LEVELS
from ..operators import erasure as S
from ..operators import governance as G
from ..operators import lineage as N
from ..sources import files
from ..sources import tables as T
from ..session import durable, shared_dir
from . import privacy
from .basis import choose, with_
from .registry import query

SECRET = b"subject-secret-for-tests"
STORES = tuple(G.ERASURE)
EXTERNAL = ("purchase",)


def _label(index):
    return T.pick(LEVELS, index)


# --- classification --------------------------------------------------------------------------

@query(
    "v01_context_labels",
    """SELECT l_orderkey, ['public', 'internal', 'confidential', 'restricted'][max(
    (l_partkey + l_linenumber) % 4 * (l_suppkey % 2))::INTEGER + 1] AS context_label FROM lineitem
    GROUP BY l_orderkey""",
)
def context_labels(spark, d):
    n = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(4)) * F.pmod("l_suppkey", F.lit(2))
    parts = T.read(spark, d, "lineitem").select("l_orderkey", _label(n).alias("label"))
    return G.context_labels(parts, "l_orderkey")


def classified_texts(spark, d):
    """Turns with salary words, marks, and the known personal data of even turns."""
    c = F.col("conv_id")
    text = F.concat(
        F.col("text"), F.when(F.pmod(c, F.lit(7)) == 0, F.lit(" BẢNG LƯƠNG quý ba")).otherwise(""),
        F.when(F.pmod(c, F.lit(5)) == 0, F.lit(" MẬT")).when(F.pmod(c, F.lit(5)) == 1, F.lit(" mật")).otherwise(""),
    )
    return T.requests_pii(spark, d).select(
        "conv_id", "turn", text.alias("text"), _label(c + F.col("turn")).alias("owner_label"),
        (F.pmod(c, F.lit(3)) == 0).alias("confirmed"),
    )


_RULES = """concat_ws(',', CASE WHEN turn % 2 = 0 THEN 'pii_sensitive' END,
    CASE WHEN conv_id % 7 = 0 THEN 'salary_keywords' END,
    CASE WHEN conv_id % 5 = 0 THEN 'marked_confidential' END)"""
_SUGGESTED = """CASE WHEN turn % 2 = 0 THEN 3 WHEN conv_id % 7 = 0 OR conv_id % 5 = 0 THEN 2 ELSE 1 END"""


@query(
    "v02_label_suggestions",
    f"""SELECT conv_id, turn, {_RULES} AS rules, ['public', 'internal', 'confidential', 'restricted']
    [{_SUGGESTED} + 1] AS suggested, ['public', 'internal', 'confidential', 'restricted'][CASE
      WHEN conv_id % 3 = 0 THEN (conv_id + turn) % 4 ELSE greatest((conv_id + turn) % 4, {_SUGGESTED})
      END + 1] AS effective FROM conversations""",
)
def label_suggestions(spark, d):
    out = G.suggest_labels(classified_texts(spark, d))
    return out.select(
        "conv_id", "turn", "rules", "suggested",
        G.effective_label(F.col("owner_label"), F.col("suggested"), F.col("confirmed")).alias("effective"),
    )


@query(
    "v03_pii_tags",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'pii:basic'
    ELSE 'pii:none' END ELSE 'pii:sensitive' END AS tag FROM conversations""",
)
def pii_tags(spark, d):
    from ..functions import pii

    odd = (F.pmod("turn", F.lit(2)) == 1) & (F.pmod("conv_id", F.lit(2)) == 0)
    t = T.requests_pii(spark, d).withColumn(
        "text", F.when(odd, F.concat("text", F.lit(" 0912345678"))).otherwise(F.col("text"))
    )
    kinds = F.transform(pii.entities(F.col("text")), lambda e: e["kind"])
    return t.select("conv_id", "turn", kinds.alias("k")).select("conv_id", "turn", G.pii_tag(F.col("k")).alias("tag"))


@query(
    "v04_handling_matrix",
    """SELECT label, count(*) FILTER (h = 'yes') AS yes, count(*) FILTER (h = 'ask') AS ask,
    count(*) FILTER (h = 'no') AS no FROM (SELECT ['public', 'internal', 'confidential', 'restricted']
      [event_id % 4 + 1] AS label, CASE WHEN event_id % 4 = 0 THEN 'yes'
      WHEN event_id % 4 = 3 THEN CASE event_id % 6 WHEN 1 THEN 'ask' ELSE 'no' END
      WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 6 IN (0, 5) THEN 'ask' ELSE 'yes' END
      ELSE CASE event_id % 6 WHEN 1 THEN 'yes' WHEN 2 THEN 'ask' WHEN 5 THEN 'ask' ELSE 'no' END END AS h
    FROM events) GROUP BY label""",
)
def handling(spark, d):
    actions = [a for a, _ in G.HANDLING]
    asked = T.events(spark, d).select(
        T.pick(actions, F.col("event_id")).alias("action"), _label(F.col("event_id")).alias("label")
    )
    counted = asked.join(G.handling(spark), ["action", "label"]).groupBy("label")
    return counted.agg(*[F.count_if(F.col("handling") == h).alias(h) for h in ("yes", "ask", "no")])


# --- policy decisions ------------------------------------------------------------------------

STATUSES = ("approved", "approved", "assessment", "approved", "review", "approved")


def usecases(spark, d):
    c = F.col("c_custkey")
    both = F.array(F.lit("view"), F.lit("purchase"))
    return T.read(spark, d, "customer").select(
        F.concat(F.lit("uc-"), c.cast("string")).alias("usecase_id"), c,
        T.pick(STATUSES, c).alias("status"),
        F.when(F.pmod(c, F.lit(2)) == 0, both).otherwise(F.array(F.lit("view"), F.lit("click"))).alias("purposes"),
        _label(F.pmod(c, F.lit(3)) + 1).alias("max_label"),
    )


def policy_requests(spark, d):
    i = F.col("event_id")
    known = F.concat(F.lit("uc-"), F.col("user_id").cast("string"))
    return T.events(spark, d).select(
        "event_id", "ts", "user_id",
        F.when(F.pmod(i, F.lit(20)) == 0, F.lit("uc-none")).otherwise(known).alias("usecase_id"),
        F.when(F.pmod(i, F.lit(3)) == 0, "tool_call").otherwise("llm_call").alias("action"),
        F.col("event_type").alias("purpose"), _label(i).alias("context_label"),
        F.when(F.pmod(i, F.lit(5)) == 0, F.array(F.lit("pii:sensitive")))
        .otherwise(F.array(F.lit("pii:none"))).alias("pii_tags"),
        F.lit("send_email").alias("tool"), F.lit("internal").alias("tool_label"),
    )


_L = "['public', 'internal', 'confidential', 'restricted']"
_DECISION = f"""(SELECT *, concat_ws(',',
    CASE WHEN lvl > ulvl THEN 'classification_exceeds_usecase' END,
    CASE WHEN event_type = 'purchase' AND lvl >= 2 THEN 'external_purpose_with_confidential' END,
    CASE WHEN NOT coalesce(list_contains(purposes, event_type), FALSE) THEN 'purpose_not_registered' END,
    CASE WHEN event_id % 3 <> 0 AND lvl = 3 THEN 'restricted_data_in_llm' END,
    CASE WHEN event_id % 3 = 0 AND lvl > 1 THEN 'tool_send_email_cannot_receive_' || {_L}[lvl + 1] END,
    CASE WHEN status <> 'approved' THEN 'usecase_not_approved' END,
    CASE WHEN status IS NULL THEN 'usecase_unknown' END) AS reasons
    FROM (SELECT e.*, (event_id % 4)::INTEGER AS lvl, CASE WHEN event_id % 20 <> 0 THEN u.status END AS status,
      CASE WHEN event_id % 20 <> 0 THEN u.purposes END AS purposes,
      CASE WHEN event_id % 20 <> 0 THEN u.ulvl END AS ulvl FROM events e
      LEFT JOIN (SELECT c_custkey, {choose(STATUSES, 'c_custkey')} AS status,
        CASE WHEN c_custkey % 2 = 0 THEN ['view', 'purchase'] ELSE ['view', 'click'] END AS purposes,
        c_custkey % 3 + 1 AS ulvl FROM customer) u ON u.c_custkey = e.user_id))"""


def decisions(spark, d):
    return G.decide(policy_requests(spark, d), usecases(spark, d), EXTERNAL)


@query(
    "v05_policy_decisions",
    f"""SELECT event_id, reasons, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'pii=mask' END,
    CASE WHEN lvl >= 2 THEN 'residency=local' END, CASE WHEN lvl >= 2 THEN 'semantic_cache=false' END,
    CASE WHEN lvl >= 2 THEN 'trace_content=false' END) AS constraints, reasons = '' AS allow
    FROM {_DECISION}""",
)
def policy_decisions(spark, d):
    return decisions(spark, d).select("event_id", "reasons", "constraints", "allow")


@query(
    "v06_decisions_in_outage",
    f"""SELECT e.event_id, CASE WHEN e.event_id % 4 >= 2 THEN 'policy_unavailable'
    WHEN e.us - x.us <= 600000000 THEN CASE WHEN x.allow THEN 'cached_allow' ELSE 'cached_deny' END
    WHEN e.event_id % 5 = 0 THEN 'default_local' ELSE 'default_allow' END AS outcome
    FROM (SELECT event_id, user_id, event_type, epoch_us(ts) + 1000000 AS us FROM events) e
    ASOF LEFT JOIN (SELECT user_id, event_type, epoch_us(ts) AS us, reasons = '' AS allow FROM {_DECISION}
      WHERE event_id % 2 = 0) x ON x.user_id = e.user_id AND x.event_type = e.event_type AND e.us >= x.us""",
)
def decisions_in_outage(spark, d):
    """Every second decision was cached; the cache lives ten minutes because traffic is sparse."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "purpose").alias("cache_key")
    cached = decisions(spark, d).filter(F.pmod("event_id", F.lit(2)) == 0).select(key, "ts", "allow")
    asked = policy_requests(spark, d).select(
        "event_id", key, (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), "context_label", "pii_tags"
    )
    return G.decide_in_outage(asked, cached, 600).select("event_id", "outcome")


@query(
    "v07_denials_by_reason",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, reason, count(*) AS denials FROM (SELECT ts,
    unnest(string_split(reasons, ',')) AS reason FROM {_DECISION} WHERE reasons <> '') GROUP BY ALL""",
)
def denials(spark, d):
    return G.denials(decisions(spark, d))


# --- provenance ------------------------------------------------------------------------------

def provenance(spark, d):
    """Answers with a document and a table as sources; every tenth event left no record."""
    i = F.col("event_id")
    sources = F.to_json(F.array(
        F.struct(F.concat(F.lit("d"), F.pmod(i, F.lit(37)).cast("string")).alias("document_id"),
                 F.lit(1).alias("version"), F.lit(None).cast("string").alias("table")),
        F.struct(F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("int").alias("version"),
                 F.concat(F.lit("t"), F.pmod(i, F.lit(3)).cast("string")).alias("table")),
    ))
    return T.events(spark, d).filter(F.pmod(i, F.lit(10)) != 0).select(
        F.concat(F.lit("trace-"), i.cast("string")).alias("trace_id"), "event_id", "ts", "tenant_id", "model",
        F.concat(F.lit("uc-"), F.pmod("user_id", F.lit(20)).cast("string")).alias("usecase_id"),
        _label(F.floor(i / 2)).alias("output_class"), sources.alias("sources"),
    )


@query(
    "v08_provenance_coverage",
    with_("ev", then="""SELECT tenant_id, count(*) AS answers, count(*) FILTER (event_id % 10 = 0) AS missing
    FROM ev GROUP BY 1"""),
)
def coverage(spark, d):
    traces = T.events(spark, d).select(
        F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"), "tenant_id"
    )
    return G.provenance_coverage(traces, provenance(spark, d))


@query(
    "v09_lineage_edges",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, source, usecase_id, count(*) AS uses FROM (SELECT ts,
    'uc-' || user_id % 20 AS usecase_id, unnest(['document:d' || event_id % 37, 'table:t' || event_id % 3])
    AS source FROM events WHERE event_id % 10 <> 0) GROUP BY ALL""",
)
def lineage(spark, d):
    return G.lineage_edges(provenance(spark, d))


def lineage_graph(spark, d):
    """Source -> use case -> output -> tool, and tools that write documents again: cycles over four hops."""
    used = G.lineage_edges(provenance(spark, d)).select(F.col("source").alias("src"), F.col("usecase_id").alias("dst"))
    e = T.events(spark, d).where("event_id % 10 <> 0")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    usecase, output = text("uc-", F.col("user_id") % 20), text("out-", F.col("user_id") % 40)
    tool = F.concat(F.lit("tool:"), "event_type", F.lit("-"), (F.col("user_id") % 40).cast("string"))
    back = text("document:d", F.col("user_id") % 40 + 20)
    pairs = [(usecase, output, True), (output, tool, F.col("event_type") != "view"), (tool, back, (F.col("user_id") % 7 == 0) & (F.col("event_type") == "error"))]
    for src, dst, when in pairs:
        used = used.unionByName(e.where(F.lit(when) if when is True else when).select(src.alias("src"), dst.alias("dst")))
    return used.distinct()


_GRAPH = """edges AS (SELECT DISTINCT src, dst FROM (
      SELECT unnest(['document:d' || event_id % 37, 'table:t' || event_id % 3]) AS src, 'uc-' || user_id % 20 AS dst
        FROM events WHERE event_id % 10 <> 0
      UNION ALL SELECT 'uc-' || user_id % 20, 'out-' || user_id % 40 FROM events WHERE event_id % 10 <> 0
      UNION ALL SELECT 'out-' || user_id % 40, 'tool:' || event_type || '-' || user_id % 40 FROM events
        WHERE event_id % 10 <> 0 AND event_type <> 'view'
      UNION ALL SELECT 'tool:' || event_type || '-' || user_id % 40, 'document:d' || (user_id % 40 + 20) FROM events
        WHERE event_id % 10 <> 0 AND user_id % 7 = 0 AND event_type = 'error'))"""


@query(
    "v09_touched_by_source",
    f"""WITH RECURSIVE {_GRAPH},
    reach AS (SELECT src AS source, dst AS node FROM edges WHERE src LIKE 'document:%' OR src LIKE 'table:%'
      UNION SELECT source, dst FROM reach JOIN edges ON src = node)
    SELECT source, node FROM reach""",
)
def touched_by_source(spark, d):
    """What removing a document or table touches, over all hops."""
    graph = durable(lineage_graph(spark, d))
    sources = graph.where("src LIKE 'document:%' OR src LIKE 'table:%'").select(F.col("src").alias("source"))
    return N.reach(graph, sources).select("source", "node")


@query(
    "v09_raised_labels",
    f"""WITH RECURSIVE {_GRAPH},
    labels AS (SELECT DISTINCT src AS node, CASE WHEN src LIKE 'table:%' THEN 1
      ELSE substr(src, 11)::INTEGER % 4 END AS level FROM edges WHERE src LIKE 'document:%' OR src LIKE 'table:%'),
    reach AS (SELECT node AS source, node FROM labels UNION SELECT source, dst FROM reach JOIN edges ON src = node)
    SELECT reach.node, max(level)::BIGINT AS level FROM reach JOIN labels ON labels.node = source GROUP BY 1""",
)
def raised_labels(spark, d):
    """The highest classification that flows into each node."""
    graph = durable(lineage_graph(spark, d))
    sources = graph.where("src LIKE 'document:%' OR src LIKE 'table:%'").select(F.col("src").alias("node")).distinct()
    level = F.when(F.col("node").startswith("table:"), 1).otherwise(F.substring("node", 11, 9).try_cast("int") % 4)
    return N.raised_labels(graph, sources.withColumn("level", level.cast("int")))


@query(
    "v10_confidential_at_cloud",
    with_("ev", then="""SELECT event_id, model FROM ev WHERE event_id % 10 <> 0
    AND (event_id // 2) % 4 >= 2 AND model <> 'mock-local-small'"""),
)
def confidential_at_cloud(spark, d):
    return G.confidential_at_cloud(provenance(spark, d), T.catalog(spark)).select("event_id", "model")


# --- data subjects ---------------------------------------------------------------------------

def _pad(byte: int) -> str:
    key = SECRET.ljust(64, b"\0")
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in key) + "'::BLOB"


def _key_sql(message: str) -> str:
    inner = f"unhex(sha256({_pad(0x36)} || encode({message})))"
    return f"'sk_' || sha256({_pad(0x5C)} || {inner})[1:32]"


@query(
    "v11_subject_keys",
    with_("ents", then=f"""SELECT conv_id, turn, kind, {_key_sql("kind || ':' || CASE WHEN kind = 'ORDER' OR kind = 'NAME' THEN value ELSE lower(value) END")} AS subject_key FROM ents"""),
)
def subject_keys(spark, d):
    """Phones arrive in international form with dots and e-mails in capitals."""
    value = F.when(F.col("kind") == "PHONE", F.concat(F.lit("+84 "), F.substring("value", 2, 4), F.lit("."),
                                                     F.substring("value", 6, 9)))
    value = value.when(F.col("kind") == "EMAIL", F.upper("value")).otherwise(F.col("value"))
    return privacy.ents(spark, d).select(
        "conv_id", "turn", "kind", G.subject_key(SECRET, F.col("kind"), value).alias("subject_key")
    )


def sightings(spark, d):
    """Where each detected identifier was seen."""
    place = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    return privacy.ents(spark, d).select(
        G.subject_key(SECRET, F.col("kind"), F.col("value")).alias("subject_key"),
        T.pick(STORES, place).alias("store"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("location"),
        F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("first_seen"), "conv_id",
    )


def subject_index(spark, d):
    seen = sightings(spark, d).drop("conv_id")
    later = seen.withColumn("first_seen", F.col("first_seen") + F.expr("INTERVAL 1 HOUR"))
    return G.upsert_subject_index(later, seen)


_SEEN = f"""(SELECT conv_id, turn, kind, value, {choose(STORES, '(conv_id + turn)')} AS store,
    conv_id || '-' || turn AS location FROM ents)"""
_ASKED = "kind IN ('PHONE', 'EMAIL', 'CCCD', 'BANK') AND conv_id % 5 = 0"


@query(
    "v12_subject_index",
    with_("ents", then=f"""SELECT {_key_sql("kind || ':' || value")} AS subject_key, store, location,
    (conv_id * 100 + turn)::BIGINT AS first_seen_s FROM {_SEEN}"""),
)
def index(spark, d):
    return subject_index(spark, d).select(
        "subject_key", "store", "location", F.unix_seconds("first_seen").alias("first_seen_s")
    )


def erasure_requests(spark, d):
    """Every fifth conversation's person asks to be erased; two phones, an e-mail, an
    identity and an account number each."""
    c = T.turns(spark, d).filter(F.pmod("conv_id", F.lit(5)) == 0).select("conv_id").distinct()

    def key(kind, value):
        return G.subject_key(SECRET, F.lit(kind), value)

    def phone(extra):
        return F.concat(F.lit("09"), F.lpad((F.col("conv_id") + extra).cast("string"), 8, "0"))

    return c.select(
        F.concat(F.lit("DSR-"), F.col("conv_id").cast("string")).alias("id"),
        F.array(key("PHONE", phone(0)), key("PHONE", phone(5_000_000)), key("EMAIL", T.known_values()["email"]),
                key("CCCD", T.known_values()["cccd"]), key("BANK", T.known_values()["bank"]))
        .alias("subject_keys"),
        F.when(F.pmod("conv_id", F.lit(10)) == 0, key("EMAIL", T.known_values()["email"])).alias("held"),
    )


def holds(spark, d):
    return erasure_requests(spark, d).filter("held IS NOT NULL").select(
        F.col("held").alias("subject_key"), F.lit(None).cast("timestamp").alias("released_at")
    )


_REPORT = f"""(SELECT 'DSR-' || conv_id AS dsr_id, store, count(*) AS found,
    count(*) FILTER (kind = 'EMAIL' AND conv_id % 10 = 0) AS held, CASE store
    WHEN 'minio' THEN 'redact_version' WHEN 'usage' THEN 'anonymise' WHEN 'agent_runs' THEN 'redact'
    ELSE 'delete' END AS action, count(*) FILTER (kind = 'EMAIL' AND conv_id % 10 = 0) AS remaining
    FROM {_SEEN} WHERE {_ASKED} GROUP BY conv_id, store)"""


@query("v13_erasure_report", with_("ents", then=f"SELECT * FROM {_REPORT}"))
def erasure_report(spark, d):
    return G.erasure_report(erasure_requests(spark, d), subject_index(spark, d), holds(spark, d))


@query(
    "v13_erasure_evidence",
    with_("ents", then=f"""SELECT dsr_id, sum(found)::BIGINT AS found, 'completed' AS status,
    sha256(string_agg(store || ':' || found || ':' || held || ':' || action || ':' || remaining, E'\\n'
      ORDER BY store || ':' || found)) AS evidence_sha256 FROM {_REPORT} GROUP BY dsr_id"""),
)
def erasure_evidence(spark, d):
    report = G.erasure_report(erasure_requests(spark, d), subject_index(spark, d), holds(spark, d))
    return G.erasure_status(report)


def stored_tables(spark, d):
    """A row of every turn in two partitioned tables: chunks, and usage with a user reference."""
    base = f"{shared_dir(spark).rstrip('/')}/stores/{uuid.uuid4().hex}"
    t = T.turns(spark, d)
    rows = t.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("location"), "text",
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("user_ref_hash"), "role", F.col("slug").alias("tenant"),
        F.pmod("conv_id", F.lit(4)).cast("int").alias("part"),
    )
    rows.drop("user_ref_hash", "tenant").write.partitionBy("role", "part").parquet(f"{base}/chunks")
    rows.drop("text", "role").write.partitionBy("tenant", "part").parquet(f"{base}/usage")
    return base, [
        S.Store("chunks", f"{base}/chunks", "location string, text string, role string, part int", "location", ("role", "part")),
        S.Store("usage", f"{base}/usage", "location string, user_ref_hash string, tenant string, part int", "location",
                ("tenant", "part"), ("user_ref_hash",)),
    ]


@query(
    "v13_erasure_stored",
    with_("ents", "turns", then=f"""SELECT store, count(*) AS found, count(*) FILTER (held) AS held, count(*) FILTER (NOT held)
      AS erased, 0::BIGINT AS remaining, (SELECT count(*) FROM turns) - CASE store WHEN 'chunks' THEN count(*) FILTER (NOT held)
      ELSE 0 END AS rows, CASE WHEN bool_and(held) THEN 0 ELSE 1 END::BIGINT AS passes, 'completed' AS status
    FROM (SELECT store, location, bool_or(kind = 'EMAIL' AND conv_id % 10 = 0) AS held FROM {_SEEN}
      WHERE {_ASKED} AND store IN ('chunks', 'usage') GROUP BY 1, 2) GROUP BY store"""),
)
def erasure_stored(spark, d):
    """The located rows leave the stored tables, but for those under a hold."""
    base, stores = stored_tables(spark, d)
    plan = G.plan_erasure(G.find_subject(erasure_requests(spark, d), subject_index(spark, d)), holds(spark, d))
    return S.erase_stored(spark, stores, durable(S.targets(plan)), f"{base}/run").drop("evidence_sha256")


@query(
    "v13_anonymised_usage",
    with_("ents", "turns", then=f"""SELECT t.conv_id, t.turn, CASE WHEN g.location IS NULL THEN
    'u' || t.conv_id END AS user_ref_hash FROM turns t LEFT JOIN (SELECT DISTINCT location FROM {_SEEN}
      WHERE {_ASKED} AND store = 'usage' AND NOT (kind = 'EMAIL' AND conv_id % 10 = 0)) g
    ON g.location = t.conv_id || '-' || t.turn"""),
)
def anonymised(spark, d):
    found = G.find_subject(erasure_requests(spark, d), subject_index(spark, d))
    usage = T.turns(spark, d).select(
        "conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("location"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("user_ref_hash"),
    )
    return G.anonymise(usage, G.plan_erasure(found, holds(spark, d))).select("conv_id", "turn", "user_ref_hash")


@query(
    "v14_restricted_requests",
    with_("ents", then="""SELECT conv_id || '-' || turn AS request_id, bool_or(conv_id % 10 = 0 AND kind = 'EMAIL')
    AS refused FROM ents GROUP BY conv_id, turn"""),
)
def restricted_requests(spark, d):
    carried = sightings(spark, d).select(F.col("location").alias("request_id"), "subject_key")
    return G.restrict(carried, holds(spark, d))


@query(
    "v14_unrestricted_chunks",
    with_("ents", "turns", then=f"""SELECT conv_id, turn FROM turns t WHERE conv_id || '-' || turn NOT IN (
    SELECT location FROM {_SEEN} WHERE store = 'chunks' AND conv_id % 10 = 0 AND kind = 'EMAIL')"""),
)
def unrestricted_chunks(spark, d):
    chunks = T.turns(spark, d).select(
        "conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("location")
    )
    return G.without_restricted(chunks, subject_index(spark, d), holds(spark, d)).select("conv_id", "turn")


# --- retention and life cycle ----------------------------------------------------------------

# How long each kind of record is kept, by label where labels differ.
RETENTION = (
    [("content", lab, "30 days") for lab in LEVELS[:2]] + [("content", lab, "0 days") for lab in LEVELS[2:]]
    + [("trace_metadata", lab, "90 days") for lab in LEVELS]
    + [(k, lab, "13 months") for k in ("answer_provenance", "policy_decisions", "usage_events") for lab in LEVELS]
    + [("exact_cache", "confidential", "1 hour"), ("exact_cache", "restricted", "0 hours")]
    + [("log", lab, "30 days") for lab in LEVELS] + [("audit_logs", lab, "12 months") for lab in LEVELS]
    + [("agent_reports", lab, "12 months") for lab in LEVELS[:3]]
)
KIND_OF = (("view", "content"), ("click", "trace_metadata"), ("purchase", "exact_cache"), ("error", "log"),
           ("signup", "usage_events"))


def retention_rules(spark):
    """The intervals as months and days, applied as timestamps."""
    rules = spark.createDataFrame(RETENTION, "kind string, label string, period string")
    number = F.substring_index("period", " ", 1).cast("int")
    unit = F.substring_index("period", " ", -1)

    def of(name):
        return F.when(unit.startswith(name), number).otherwise(0)

    return rules.select("kind", "label", of("month").alias("months"), of("day").alias("days"), of("hour").alias("hours"))


@query(
    "v16_retention_sweep",
    f"""SELECT kind, label, count(*) AS deleted FROM (SELECT event_id, user_id, ts,
      CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND_OF)} END AS kind,
      {_L}[event_id % 4 + 1] AS label FROM events) JOIN (VALUES
      {', '.join(f"('{k}', '{lab}', INTERVAL '{p}')" for k, lab, p in RETENTION)}) r(k, l, p)
    ON k = kind AND l = label WHERE ts + p < TIMESTAMP '2024-02-15' AND user_id % 50 <> 0 GROUP BY 1, 2""",
)
def retention_sweep(spark, d):
    kind = F
    for a, b in KIND_OF:
        kind = kind.when(F.col("event_type") == a, b)
    records = T.events(spark, d).select(
        "event_id", "ts", kind.otherwise(F.lit(None).cast("string")).alias("kind"), _label(F.col("event_id")).alias("label"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("scope"),
    )
    held = T.events(spark, d).filter(F.pmod("user_id", F.lit(50)) == 0).select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("scope")
    ).distinct()
    now = F.lit("2024-02-15").cast("timestamp")
    return G.sweep_report(G.expired(records, retention_rules(spark), held, now))


@query(
    "v15_legal_holds",
    """SELECT c_custkey, count(*) AS due, count(*) FILTER (c_custkey % 3 = 0) AS held FROM orders
    JOIN customer ON c_custkey = o_custkey WHERE o_orderdate + INTERVAL 12 MONTH < TIMESTAMP '2000-01-01'
    GROUP BY c_custkey""",
)
def legal_holds(spark, d):
    """Orders as audit records of a customer; every third customer is under a hold."""
    c = F.col("o_custkey")
    records = T.read(spark, d, "orders").select(
        c.alias("c_custkey"), F.lit("audit_logs").alias("kind"), F.lit("internal").alias("label"),
        F.col("o_orderdate").alias("ts"), F.concat(F.lit("customer:"), c.cast("string")).alias("scope"),
    )
    held = T.read(spark, d, "customer").filter(F.pmod("c_custkey", F.lit(3)) == 0).select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("scope")
    )
    now = F.lit("2000-01-01").cast("timestamp")
    rules = retention_rules(spark)
    due = G.expired(records, rules, held.filter(F.lit(False)), now).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("due"))
    gone = G.expired(records, rules, held, now).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("gone"))
    return due.join(gone, "c_custkey", "left").select(
        "c_custkey", "due", (F.col("due") - F.coalesce("gone", F.lit(0))).alias("held")
    )


def documents_lifecycle(spark, d):
    o = F.col("o_orderkey")
    until = F.to_date("o_orderdate")
    return T.read(spark, d, "orders").select(
        o, F.when(F.pmod(o, F.lit(11)) != 0, until).alias("certified_until"),
        F.when(F.pmod(o, F.lit(13)) == 0, F.lit("1999-01-01").cast("date")).alias("valid_until"),
        (F.pmod(o, F.lit(7)) == 0).alias("superseded"), (F.pmod(o, F.lit(5)) != 0).alias("confirmed"),
        (F.pmod(o, F.lit(2)) == 0).alias("allow_expired"), (F.pmod(o, F.lit(3)) != 0).alias("has_owner"),
    )


_STATE = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 THEN 'ARCHIVED'
    WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'AWAITING_LABEL'
    WHEN DATE '1999-06-15' <= o_orderdate::DATE THEN 'CERTIFIED'
    WHEN DATE '1999-06-15' <= o_orderdate::DATE + 30 THEN 'REVIEW_DUE' ELSE 'EXPIRED' END AS state FROM orders)"""


def lifecycle(spark, d):
    return G.lifecycle(documents_lifecycle(spark, d), F.lit("1999-06-15").cast("date"))


@query(
    "v17_document_lifecycle",
    f"""SELECT o_orderkey, state, state IN ('CERTIFIED', 'REVIEW_DUE') OR (state = 'EXPIRED'
    AND o_orderkey % 2 = 0) AS usable FROM {_STATE}""",
)
def document_lifecycle(spark, d):
    return lifecycle(spark, d).select("o_orderkey", "state", "usable")


@query(
    "v18_table_checks",
    """SELECT 'row_count' AS "check", count(*) AS value, count(*) > 0 AS ok FROM orders
    UNION ALL SELECT 'freshness', (epoch_us(TIMESTAMP '2003-01-01') - epoch_us(max(o_orderdate))) // 3600000000,
      (epoch_us(TIMESTAMP '2003-01-01') - epoch_us(max(o_orderdate))) // 3600000000 < 24 FROM orders
    UNION ALL SELECT 'missing_count', count(*) FILTER (o_orderkey % 9 = 0), count(*) FILTER (o_orderkey % 9 = 0) = 0
      FROM orders
    UNION ALL SELECT 'duplicate_count', (count(*) - count(DISTINCT (o_orderdate, o_orderstatus)))::BIGINT,
      count(*) = count(DISTINCT (o_orderdate, o_orderstatus)) FROM orders""",
)
def table_checks(spark, d):
    o = T.read(spark, d, "orders").withColumn(
        "category", F.when(F.pmod("o_orderkey", F.lit(9)) != 0, F.col("o_orderpriority"))
    )
    return G.table_checks(o, "o_orderdate", "category", ["o_orderdate", "o_orderstatus"], F.lit("2003-01-01").cast("timestamp"))


# --- registry --------------------------------------------------------------------------------

GATES = ("draft", "assessment", "rejected", "approved", "review", "retired")


@query(
    "v19_key_gate",
    f"""SELECT o_orderkey, CASE WHEN s = 'retired' THEN 'usecase_retired'
    WHEN s IN ('draft', 'assessment', 'rejected') AND live THEN 'usecase_not_approved'
    WHEN s IN ('draft', 'assessment', 'rejected') AND lvl > 1 THEN 'label_too_high_for_test'
    WHEN s = 'review' AND live AND overdue > 14 THEN 'review_overdue' WHEN s = 'review' AND live THEN 'warn'
    ELSE 'ok' END AS gate FROM (SELECT o_orderkey, {choose(GATES, 'c_custkey')} AS s, o_orderkey % 2 = 0 AS live,
      o_orderkey % 4 AS lvl, c_custkey % 30 AS overdue FROM orders JOIN customer ON c_custkey = o_custkey)""",
)
def key_gate(spark, d):
    registry = T.read(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), T.pick(GATES, F.col("c_custkey")).alias("status"),
        F.pmod("c_custkey", F.lit(30)).alias("overdue"),
    )
    keys = T.read(spark, d, "orders").join(registry, "o_custkey")
    kind = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "live").otherwise("test")
    gate = G.key_gate(F.col("status"), kind, _label(F.col("o_orderkey")), F.col("overdue"))
    return keys.select("o_orderkey", gate.alias("gate"))


def registry_versions(spark, d):
    """Lines of an order as versions of a use case."""
    n = F.col("l_partkey") + F.col("l_linenumber")

    def some(k, *names):
        return F.slice(F.array(*[F.lit(x) for x in names]), 1, (F.pmod(n, F.lit(k)) + 0).cast("int"))

    return T.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey")
    ).select(
        F.col("l_orderkey").alias("usecase_id"), F.col("l_linenumber").alias("version"),
        some(3, "mock-cloud-small", "mock-claude").alias("cloud_models"), _label(n).alias("max_label"),
        some(4, "PHONE", "EMAIL", "NAME").alias("pii_kinds"), some(2, "send_email").alias("external_tools"),
    )


@query(
    "v20_major_changes",
    """WITH v AS (SELECT l_orderkey, l_linenumber, max(l_partkey) + l_linenumber AS n FROM lineitem
      GROUP BY l_orderkey, l_linenumber HAVING (l_orderkey + l_linenumber) % 4 <> 0),
    p AS (SELECT b.l_orderkey, b.l_linenumber, concat_ws(',',
      CASE WHEN b.n % 3 > a.n % 3 THEN 'cloud_model_added' END,
      CASE WHEN b.n % 4 > a.n % 4 THEN 'label_raised' END, CASE WHEN b.n % 4 > a.n % 4 THEN 'pii_added' END,
      CASE WHEN b.n % 2 > a.n % 2 THEN 'external_tool_added' END) AS changes
      FROM v b JOIN (SELECT l_orderkey, l_linenumber, lag(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n
        FROM v) a USING (l_orderkey, l_linenumber))
    SELECT l_orderkey AS usecase_id, l_linenumber::BIGINT AS version, changes FROM p WHERE changes <> ''""",
)
def major_changes(spark, d):
    """Every fourth version is not in the registry; its number is a gap."""
    return G.major_changes(registry_versions(spark, d).where("(usecase_id + version) % 4 <> 0"))


_TIER = """CASE WHEN c_custkey % 4 >= 2 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'high'
    WHEN c_custkey % 7 < 3 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'medium' ELSE 'low' END"""


@query(
    "v21_risk_tiers",
    f"""SELECT c_custkey, tier, strftime(DATE '2024-01-31' + CASE tier WHEN 'high' THEN INTERVAL 3 MONTH
    WHEN 'medium' THEN INTERVAL 6 MONTH ELSE INTERVAL 12 MONTH END, '%Y-%m-%d') AS next_review
    FROM (SELECT c_custkey, {_TIER} AS tier FROM customer)""",
)
def risk_tiers(spark, d):
    c = F.col("c_custkey")

    def every(n):
        return F.pmod(c, F.lit(n)) == 0

    tag = F.when(every(7), "pii:sensitive").when(F.pmod(c, F.lit(7)) < 3, "pii:basic").otherwise("pii:none")
    tier = G.risk_tier(_label(c), tag, every(3), every(5), every(11), every(13))
    return T.read(spark, d, "customer").select(c, tier.alias("tier")).select(
        c, "tier", G.next_review(F.lit("2024-01-31").cast("date"), F.col("tier")).alias("next_review")
    )


def usage_by_usecase(spark, d):
    return T.events(spark, d).select(F.concat(F.lit("uc-"), F.col("user_id").cast("string")).alias("usecase_id"), "model")


def records(spark, d):
    registry = usecases(spark, d).select(
        "usecase_id", F.concat(F.lit("owner-"), F.pmod("c_custkey", F.lit(9)).cast("string")).alias("owner"), "purposes",
        F.array(F.lit("PHONE"), F.lit("EMAIL")).alias("pii_kinds"), F.lit("2024-06-30").cast("date").alias("review_due"),
    )
    known = T.catalog(spark).filter("id <> 'mock-claude'")  # one recipient is unknown
    return G.processing_records(registry, usage_by_usecase(spark, d), known)


_ROPA = """SELECT 'uc-' || c_custkey AS usecase_id, 'owner-' || c_custkey % 9 AS owner,
    CASE WHEN c_custkey % 2 = 0 THEN 'view,purchase' ELSE 'view,click' END AS purposes, 'PHONE,EMAIL' AS pii_kinds,
    coalesce(r, '') AS recipients, coalesce(abroad, FALSE) AS abroad, '2024-06-30' AS review_due FROM customer
    LEFT JOIN (SELECT user_id, string_agg(DISTINCT model, ',' ORDER BY model) AS r,
      bool_or(model <> 'mock-local-small') AS abroad FROM ev GROUP BY user_id) ON user_id = c_custkey"""


@query("v22_processing_records", with_("ev", then=_ROPA))
def processing_records(spark, d):
    return records(spark, d)


@query("s09_csv_export", with_("ev", then=_ROPA))
def csv_export(spark, d):
    """The register written as CSV and read back."""
    path = files.export_path(shared_dir(spark), "ropa")
    files.export_csv(records(spark, d), path)
    back = files.read_csv(spark, path, "usecase_id string, owner string, purposes string, pii_kinds string, "
                          "recipients string, abroad boolean, review_due string")
    return back.fillna("")


@query(
    "s09_json_export",
    """SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL""",
)
def json_export(spark, d):
    report = T.read(spark, d, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )
    path = files.export_path(shared_dir(spark), "documents")
    files.export_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "s08_golden_set",
    """SELECT 'g-' || item_id AS id, text AS input, 'faq' AS task, 'Tài liệu ' || item_id AS must_cite,
    CASE WHEN item_id % 2 = 0 THEN 'a,b' ELSE '' END AS tags FROM benchmark""",
)
def golden_set(spark, d):
    """Golden questions written as JSON lines and read with their fixed schema."""
    i = F.col("item_id")
    rows = T.read(spark, d, "benchmark").select(
        F.concat(F.lit("g-"), i.cast("string")).alias("id"), F.col("text").alias("input"),
        F.create_map(F.lit("task"), F.lit("faq")).alias("metadata"), F.lit("đáp án").alias("expected"),
        F.array(F.concat(F.lit("Tài liệu "), i.cast("string"))).alias("must_cite"),
        F.when(F.pmod(i, F.lit(2)) == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    path = files.export_path(shared_dir(spark), "golden")
    files.export_json(rows, path)
    return files.read_golden(spark, path).select(
        "id", "input", F.element_at("metadata", F.lit("task")).alias("task"), "must_cite", "tags"
    )


@query(
    "v23_cross_border",
    with_("ev", then="""SELECT usecase_id, coalesce(n, 0) AS cloud_calls, CASE WHEN declared IS NULL THEN 'not_registered'
    WHEN coalesce(n, 0) > 0 AND NOT declared THEN 'undeclared' WHEN coalesce(n, 0) = 0 AND declared THEN 'unused'
    ELSE 'matches' END AS verdict FROM (SELECT 'uc-' || user_id AS usecase_id, count(*) AS n FROM ev
      WHERE model <> 'mock-local-small' GROUP BY 1)
    FULL JOIN (SELECT 'uc-' || c_custkey AS usecase_id, c_custkey % 3 <> 0 AS declared FROM customer
      WHERE c_custkey % 10 <> 0) USING (usecase_id)"""),
)
def cross_border(spark, d):
    registry = usecases(spark, d).filter(F.pmod("c_custkey", F.lit(10)) != 0).withColumn(
        "declared_abroad", F.pmod("c_custkey", F.lit(3)) != 0
    )
    return G.cross_border(usage_by_usecase(spark, d), T.catalog(spark).filter("id <> 'mock-claude'"), registry)


@query(
    "v24_kpi_board",
    f"""SELECT 'confirmed_documents_pct' AS kpi, round(100 * count(*) FILTER (o_orderkey % 3 <> 0) / count(*), 4) AS value
      FROM {_STATE} WHERE state IN ('CERTIFIED', 'REVIEW_DUE')
    UNION ALL SELECT 'documents_overdue_pct', round(100 * count(*) FILTER (state IN ('REVIEW_DUE', 'EXPIRED')) / count(*), 4)
      FROM {_STATE} WHERE state IN ('CERTIFIED', 'REVIEW_DUE', 'EXPIRED')
    UNION ALL SELECT 'confidential_at_cloud', count(*) FROM events WHERE event_id % 10 <> 0
      AND (event_id // 2) % 4 >= 2 AND event_id % 3 <> 1
    UNION ALL SELECT 'provenance_pct', round(100 * count(*) FILTER (event_id % 10 <> 0) / count(*), 4) FROM events
    UNION ALL SELECT 'dsr_median_hours', quantile_cont(o_orderkey % 40, 0.5) FROM orders WHERE o_orderkey % 6 <> 0
    UNION ALL SELECT 'dsr_overdue', count(*) FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 40 > 24
    UNION ALL SELECT 'usecases_overdue', count(*) FROM customer WHERE c_custkey % 6 IN (0, 1, 3, 5) AND c_custkey % 30 > 0
    UNION ALL SELECT 'dq_issues_open_over_7_days', count(*) FROM orders WHERE o_orderstatus = 'O'
      AND o_orderdate < TIMESTAMP '1999-06-08'""",
)
def kpi_board(spark, d):
    docs = lifecycle(spark, d)

    def pct(part, whole=None):
        total = F.count(F.lit(1)) if whole is None else whole
        return F.round(100 * F.count_if(part) / total, 4)

    o = T.read(spark, d, "orders")
    hours = F.pmod("o_orderkey", F.lit(40))
    done = o.filter(F.pmod("o_orderkey", F.lit(6)) != 0).groupBy(hours.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    answers = T.events(spark, d).select(F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"), "tenant_id")
    cover = G.provenance_coverage(answers, provenance(spark, d))
    in_use = F.col("state").isin("CERTIFIED", "REVIEW_DUE")
    late = F.col("state").isin("REVIEW_DUE", "EXPIRED")
    overdue = (F.col("status") == "approved") & (F.pmod("c_custkey", F.lit(30)) > 0)
    stale = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1999-06-08").cast("timestamp"))
    return T.union_all([
        G.kpi(docs.filter(in_use), "confirmed_documents_pct", pct(F.col("has_owner"))),
        G.kpi(docs.filter(in_use | late), "documents_overdue_pct", pct(late)),
        G.kpi(G.confidential_at_cloud(provenance(spark, d), T.catalog(spark)), "confidential_at_cloud", F.count(F.lit(1))),
        G.kpi(cover, "provenance_pct", F.round(100 * (F.sum("answers") - F.sum("missing")) / F.sum("answers"), 4)),
        G.kpi(done, "dsr_median_hours", F.percentile("h", 0.5, F.col("n"))),
        G.kpi(done, "dsr_overdue", F.sum(F.when(F.col("h") > 24, F.col("n")).otherwise(0))),
        G.kpi(usecases(spark, d), "usecases_overdue", F.count_if(overdue)),
        G.kpi(o, "dq_issues_open_over_7_days", F.count_if(stale)),
    ])
