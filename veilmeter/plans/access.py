"""Routing, access, tenant-policy and audit queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numbers import epoch_text
from ..operators import audit as A
from ..operators import policies as S
from ..operators import routing as R
from ..schemas import violations
from ..session import shared_dir
from ..sources import isolation
from ..sources import tables as T
from .basis import choose, with_
from .registry import query

LOCAL_DEFAULT = "mock-local-small"


def labelled_requests(spark, d):
    """Requests with headers in up to four places and key metadata as JSON."""
    i = F.col("event_id")

    def place(n, *pairs):
        return F.when(F.pmod(i, F.lit(n)) == 0, F.create_map(*[F.lit(x) for x in pairs]))

    flags = ('{"service": true}', '{"service": "true"}', '{"service": false}', "{}")
    return T.events(spark, d).select(
        "event_id", "tenant_id", "slug", "model", "tokens_in", "event_type", "ts",
        place(2, "X-Context-Label", "internal", "X-Trace", "a").alias("h1"),
        place(3, "x-context-LABEL", " Confidential ").alias("h2"),
        place(5, "x-context-label", "restricted", "X-TRACE", "b").alias("h3"),
        place(7, "other", "1").alias("h4"),
        T.pick(flags, i).alias("key_metadata"),
    )


_LABEL = """CASE WHEN event_id % 5 = 0 THEN 'restricted' WHEN event_id % 3 = 0 THEN ' Confidential '
    WHEN event_id % 2 = 0 THEN 'internal' END"""
_TRUSTED = f"CASE WHEN event_id % 4 = 0 THEN lower(trim({_LABEL})) END"


@query(
    "g01_merge_headers",
    with_("ev", then=f"""SELECT event_id, {_LABEL} AS label, CASE WHEN event_id % 5 = 0 THEN 'b'
    WHEN event_id % 2 = 0 THEN 'a' END AS trace, (event_id % 2 = 0 OR event_id % 5 = 0)::BIGINT
    + (event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0)::BIGINT
    + (event_id % 7 = 0)::BIGINT AS headers FROM ev"""),
)
def merge_headers(spark, d):
    h = R.merge_headers(*[F.col(f"h{n}") for n in (1, 2, 3, 4)])
    return labelled_requests(spark, d).select("event_id", h.alias("h")).select(
        "event_id", F.try_element_at("h", F.lit("x-context-label")).alias("label"),
        F.try_element_at("h", F.lit("x-trace")).alias("trace"), F.size("h").alias("headers"),
    )


def with_label(spark, d):
    h = R.merge_headers(*[F.col(f"h{n}") for n in (1, 2, 3, 4)])
    return labelled_requests(spark, d).withColumn(
        "label", R.trusted_label(h, F.col("key_metadata"))
    )


@query("g02_trusted_label", with_("ev", then=f"SELECT event_id, {_TRUSTED} AS label FROM ev"))
def trusted_label(spark, d):
    return with_label(spark, d).select("event_id", "label")


@query(
    "g03_route_by_label",
    with_("ev", then=f"""SELECT event_id, coalesce(label IN ('confidential', 'restricted'), FALSE)
      AS disable_fallbacks,
    CASE WHEN label IN ('confidential', 'restricted') THEN 'mock-local-small' ELSE model END
      AS routed_model,
    CASE WHEN label IN ('confidential', 'restricted') THEN 'label=' || label END AS routing_reason
    FROM (SELECT *, {_TRUSTED} AS label FROM ev)"""),
)
def route_by_label(spark, d):
    return R.route_by_label(with_label(spark, d), T.catalog(spark), LOCAL_DEFAULT).select(
        "event_id", "disable_fallbacks", "routed_model", "routing_reason"
    )


@query(
    "g04_refused_models",
    with_("ev", "allowed", then="""SELECT slug, model, count(*) AS refused FROM ev
    WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.slug = ev.slug AND a.model = ev.model)
    GROUP BY slug, model"""),
)
def refused_models(spark, d):
    allowed = T.tenants(spark).select("tenant_id", F.explode("allow").alias("model"))
    return R.refused_models(T.events(spark, d), allowed).groupBy("slug", "model").agg(
        F.count(F.lit(1)).alias("refused")
    )


CHAINS = (("mock-cloud-small", ["mock-local-small"]), ("mock-local-small", ["mock-cloud-small"]))


@query(
    "g05_fallback_chain",
    # A model is out in an hour in which one of its calls failed.
    with_("ev", then=f"""SELECT event_id, CASE WHEN NOT out0 THEN model
      WHEN NOT sensitive AND other IS NOT NULL AND NOT out1 THEN other END AS served_model,
    CASE WHEN NOT out0 THEN FALSE WHEN NOT sensitive AND other IS NOT NULL AND NOT out1 THEN TRUE
      END AS fell_back FROM (
    SELECT e.event_id, e.model, other, sensitive, a.model IS NOT NULL AS out0,
      b.model IS NOT NULL AS out1
    FROM (SELECT *, us // 3600000000 AS hour, coalesce({_TRUSTED} IN ('confidential', 'restricted'),
        FALSE) AS sensitive, CASE model WHEN 'mock-cloud-small' THEN 'mock-local-small'
        WHEN 'mock-local-small' THEN 'mock-cloud-small' END AS other FROM ev) e
    LEFT JOIN (SELECT DISTINCT us // 3600000000 AS hour, model FROM ev WHERE event_type = 'error') a
      ON a.hour = e.hour AND a.model = e.model
    LEFT JOIN (SELECT DISTINCT us // 3600000000 AS hour, model FROM ev WHERE event_type = 'error') b
      ON b.hour = e.hour AND b.model = e.other)"""),
)
def fallback(spark, d):
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    requests = with_label(spark, d).withColumn("hour", hour).withColumn(
        "disable_fallbacks",
        F.coalesce(F.col("label").isin("confidential", "restricted"), F.lit(False)),
    )
    down = (
        T.events(spark, d).filter("event_type = 'error'").select(hour.alias("hour"), "model").distinct()
    )
    chains = spark.createDataFrame(list(CHAINS), "model string, fallbacks array<string>")
    return R.with_fallback(requests, chains, down, ["hour"]).select(
        "event_id", "served_model", "fell_back"
    )


ROUTES = (
    (0, "faq", 2000, ["mock-local-small", "mock-cloud-small"]),
    (1, "complaint", None, ["mock-claude"]),
    (2, None, None, ["mock-claude", "mock-cloud-small", "mock-local-small"]),
)


@query(
    "g06_choose_model",
    # Local models are out; the first tenant is over its budget of one dollar and downgrades.
    with_("ev", then="""SELECT event_id, CASE
    WHEN slug = 'hr' THEN NULL
    WHEN event_type = 'view' AND tokens_in * 10 < 2000 THEN 'mock-cloud-small'
    WHEN event_type = 'error' THEN CASE slug WHEN 'cskh' THEN 'mock-claude' END
    WHEN slug = 'cskh' AND NOT over_budget THEN 'mock-claude' ELSE 'mock-cloud-small' END
      AS chosen_model, slug = 'cskh' AND over_budget AS downgraded
    FROM (SELECT *, (SELECT sum(cost_micros) FROM ev WHERE slug = 'cskh') >= 1000000 AS over_budget
      FROM ev)"""),
)
def choose_model(spark, d):
    task = F.when(F.col("event_type") == "view", "faq").when(F.col("event_type") == "error", "complaint")
    requests = T.events(spark, d).select(
        "event_id", "tenant_id", "slug", task.alias("task"),
        (F.col("tokens_in") * 10).alias("input_tokens"),
    )
    tenants = T.tenants(spark)
    rows = [(t[1], n, k, m, use) for t in T.TENANTS for n, k, m, use in ROUTES]
    routes = spark.createDataFrame(
        rows, "tenant_id string, route_no int, task string, max_input_tokens int, "
        "use_models array<string>",
    )
    allowed = tenants.select("tenant_id", "data_residency", F.explode("allow").alias("model"))
    spent = T.events(spark, d).groupBy("tenant_id", "slug").agg(
        (F.sum("cost_micros") / 1_000_000).alias("spent_usd")
    ).select(
        "tenant_id", "spent_usd", F.when(F.col("slug") == "cskh", 1).otherwise(10**9).alias("budget_usd"),
        F.lit("downgrade").alias("on_hard_limit"),
    )
    breakers = spark.createDataFrame([("ollama",)], "provider string")
    return R.choose_model(requests, routes, allowed, T.catalog(spark), breakers, spent).select(
        "event_id", "chosen_model", "downgraded"
    )


def tenant_documents(spark, d):
    docs = T.read(spark, d, "documents")
    group = T.pick(("nhan-vien", "quan-ly", "ke-toan"), F.col("doc_id"))
    extra = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.array(group, F.lit("all"))).otherwise(F.array(group))
    return docs.select(
        "doc_id", "source", "lang", "n_chars",
        T.pick([t[1] for t in T.TENANTS], F.floor(F.col("doc_id") / 3)).alias("tenant_id"),
        extra.alias("acl_groups"),
    )


_DOCS = f"""(SELECT doc_id, source, n_chars, {choose([t[1] for t in T.TENANTS], '(doc_id // 3)')} AS tenant_id,
    {choose(('nhan-vien', 'quan-ly', 'ke-toan'), 'doc_id')} AS grp FROM documents)"""


@query(
    "g07_tenant_view",
    f"""SELECT doc_id, source FROM {_DOCS} WHERE tenant_id = '{T.TENANTS[1][1]}'""",
)
def tenant_view(spark, d):
    docs = tenant_documents(spark, d)
    hidden = R.tenant_view(docs, None)
    return R.tenant_view(docs, T.TENANTS[1][1]).unionByName(hidden).select("doc_id", "source")


@query(
    "g08_acl_filter",
    f"""SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM {_DOCS}
    WHERE grp = 'ke-toan' OR doc_id % 4 = 0 GROUP BY source""",
)
def acl_filter(spark, d):
    return R.readable(tenant_documents(spark, d), ["ke-toan", "all"]).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )


@query(
    "g08_visible_in_sql",
    f"""SELECT tenant_id, id, acl_group FROM (SELECT tenant_id, doc_id AS id, grp AS acl_group FROM {_DOCS}
    WHERE doc_id % 17 <> 0 AND grp IN ('ke-toan', 'quan-ly')) WHERE tenant_id <> '{T.TENANTS[2][1]}'""",
)
def visible_in_sql(spark, d):
    """Plain SQL over the table function: two tenants in turn, a third without groups, and nobody."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    i = F.col("doc_id")
    T.read(spark, d, "documents").select(
        T.pick([t[1] for t in T.TENANTS], F.floor(i / 3)).alias("tenant_id"), i.alias("id"), (F.pmod(i, F.lit(17)) == 0).alias("quarantined"),
        F.array(T.pick(("nhan-vien", "quan-ly", "ke-toan"), i)).alias("acl_groups"),
    ).write.parquet(path)
    isolation.install(spark, path)
    out = None
    for tenant, groups in [(t[1], ("ke-toan", "quan-ly")) for t in T.TENANTS[:2]] + [(T.TENANTS[2][1], ()), (None, ("ke-toan",))]:
        isolation.act_as(spark, tenant, groups)
        seen = spark.sql("SELECT tenant_id, id, acl_groups[0] AS acl_group FROM visible_chunks()")
        out = seen if out is None else out.unionByName(seen)
    return out


@query(
    "g09_api_key_checks",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown'
    WHEN c_custkey % 7 = 0 AND o_orderdate >= TIMESTAMP '1998-01-01' THEN 'revoked'
    WHEN c_custkey % 5 = 0 AND o_orderdate >= TIMESTAMP '1997-01-01' THEN 'expired'
    WHEN c_custkey % 3 = 0 THEN 'scope' ELSE 'ok' END AS verdict
    FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def key_checks(spark, d):
    c = F.col("c_custkey")

    def sometimes(n, day):
        return F.when(F.pmod(c, F.lit(n)) == 0, F.lit(day).cast("timestamp"))

    def secret(key):
        return F.concat(F.lit("key_live_"), key.cast("string"))

    keys = T.read(spark, d, "customer").select(
        F.sha2(secret(c), 256).alias("key_hash"),
        T.pick([t[1] for t in T.TENANTS], c).alias("tenant_id"),
        F.when(F.pmod(c, F.lit(3)) == 0, F.array(F.lit("embeddings")))
        .otherwise(F.array(F.lit("chat"), F.lit("embeddings"))).alias("scopes"),
        sometimes(5, "1997-01-01").alias("expires_at"),
        sometimes(7, "1998-01-01").alias("revoked_at"),
    )
    wrong = F.pmod("o_orderkey", F.lit(10)) == 0
    presented = T.read(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ts"),
        F.when(wrong, F.lit("key_live_x")).otherwise(secret(F.col("o_custkey"))).alias("secret"),
    )
    return R.check_keys(presented, keys, "chat").select("o_orderkey", "verdict")


# --- tenant policies -------------------------------------------------------------------------

def policy_documents(spark, d):
    """One policy document per customer, with a fault chosen by its key."""
    c = F.col("c_custkey")

    def fault(n, bad, good):
        return F.when(F.pmod(c, F.lit(n)) == 0, F.lit(bad)).otherwise(F.lit(good))

    uid = F.concat(F.lit("3edc0d7b-5f10-5295-bb88-"), F.lpad(c.cast("string"), 12, "0"))
    body = F.concat(
        F.lit('{"version": '), fault(11, "0", "2"),
        F.lit(', "tenant": {"id": "'), F.when(F.pmod(c, F.lit(13)) == 0, "x").otherwise(uid),
        F.lit('", "slug": "t", "data_residency": "'), fault(3, "moon", "any"),
        F.lit('"}, "limits": {"monthly_budget_usd": 50, "warning_budget_usd": '), fault(5, "60", "40"),
        F.lit(', "rpm": '), fault(7, "-1", "60"), F.lit(', "tpm": 60000}'),
        F.when(F.pmod(c, F.lit(17)) != 0, F.concat(
            F.lit(', "models": {"allow": '), fault(19, "[]", '["m"]'), F.lit("}"))).otherwise(""),
        F.lit(', "guardrails": {"pii": "'), fault(2, "hide", "redact"),
        F.lit('", "pii_restore": '), fault(23, '"true"', "true"),
        F.lit(', "injection": "block"}}'),
    )
    return T.read(spark, d, "customer").select("c_custkey", body.alias("spec"))


@query(
    "s05_policy_validation",
    """SELECT c_custkey, concat_ws(',',
    CASE WHEN c_custkey % 17 = 0 THEN 'section:models' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'tenant.id' END,
    CASE WHEN c_custkey % 3 = 0 THEN 'tenant.data_residency' END,
    CASE WHEN c_custkey % 2 = 0 THEN 'guardrails.pii' END,
    CASE WHEN c_custkey % 23 = 0 THEN 'guardrails.pii_restore' END,
    CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'models.allow' END,
    CASE WHEN c_custkey % 11 = 0 THEN 'version' END,
    CASE WHEN c_custkey % 7 = 0 THEN 'limits.rpm' END,
    CASE WHEN c_custkey % 5 = 0 THEN 'limits.warning' END) AS broken FROM customer""",
)
def policy_validation(spark, d):
    return S.check_policies(policy_documents(spark, d)).select("c_custkey", "broken")


@query(
    "s06_policy_upsert",
    """SELECT o_custkey AS tenant_id, left(o_orderpriority, 1)::BIGINT AS version,
    arg_max(o_orderstatus, o_orderkey) AS spec, max(o_orderkey) AS load_seq FROM orders
    GROUP BY ALL""",
)
def policy_upsert(spark, d):
    rows = T.read(spark, d, "orders").select(
        F.col("o_custkey").alias("tenant_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("version"),
        F.col("o_orderstatus").alias("spec"), F.col("o_orderkey").alias("load_seq"),
    )
    older = F.pmod("load_seq", F.lit(2)) == 0
    return S.upsert(rows.filter(older), rows.filter(~older), ["tenant_id", "version"], "load_seq")


@query(
    "s05_table_constraints",
    """SELECT 'check:data_residency' AS rule, count(*) FILTER (c_custkey % 3 = 0) AS broken FROM customer
    UNION ALL SELECT 'check:status', count(*) FILTER (c_mktsegment NOT IN ('BUILDING')) FROM customer
    UNION ALL SELECT 'unique:id', 0 FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'unique:slug', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1
      HAVING count(*) > 1)""",
)
def table_constraints(spark, d):
    rows = T.read(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("slug"),
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, "moon").otherwise("any").alias("data_residency"),
        F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("odd").alias("status"),
    )
    return violations(rows, "tenants")


# --- audit -----------------------------------------------------------------------------------

def audit_raw(spark, d):
    """Audit records: some hide content under a nested key, some carry an array or broken JSON."""
    i = F.col("event_id")

    def every(n):
        return F.pmod(i, F.lit(n)) == 0

    detail = (
        F.when(every(13), F.lit('{"meta": {"Text": "raw"}}')).when(every(17), F.lit("[1, 2]"))
        .when(every(19), F.lit("{broken")).when(every(23), F.lit('{"note": "text: prompt"}'))
        .otherwise(F.concat(F.lit('{"count": '), F.pmod(i, F.lit(5)).cast("string"), F.lit("}")))
    )
    fields = F.create_map(
        F.lit("ts"), F.when(every(29), F.lit("soon")).otherwise(epoch_text(F.col("us"))),
        F.lit("actor"), F.when(every(31), F.lit(" ")).otherwise(F.concat(F.lit("tenant:"), "slug")),
        F.lit("action"), T.pick(("guardrail.pii_redacted", "guardrail.pii_blocked",
                                 "guardrail.injection_blocked"), i),
        F.lit("resource"), F.concat(F.lit("request:"), i.cast("string")),
        F.lit("detail"), detail,
    )
    copies = F.when(every(50), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return T.events(spark, d).select(
        i.cast("string").alias("stream_id"), fields.alias("fields"), F.explode(copies).alias("copy")
    ).drop("copy")


_ACTIONS = choose(("guardrail.pii_redacted", "guardrail.pii_blocked", "guardrail.injection_blocked"),
                  "event_id")
_AUDIT = f"""(SELECT event_id, ts, slug, us, {_ACTIONS} AS action, CASE
    WHEN event_id % 29 = 0 THEN 'ts không hợp lệ'
    WHEN event_id % 13 = 0 THEN 'detail không được chứa nội dung request'
    WHEN event_id % 17 = 0 THEN 'detail phải là JSON object'
    WHEN event_id % 19 = 0 THEN 'detail không phải JSON'
    WHEN event_id % 31 = 0 THEN 'Thiếu actor' END AS reason,
    CASE WHEN event_id % 23 = 0 THEN '{{"note":"text: prompt"}}'
      ELSE '{{"count":' || event_id % 5 || '}}' END AS detail,
    unnest(CASE WHEN event_id % 50 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM ev)"""


@query(
    "a02_read_audit_records",
    with_("ev", then=f"""SELECT event_id::VARCHAR AS stream_id, reason,
    CASE WHEN reason IS NULL THEN us END AS ts_us,
    CASE WHEN reason IS NULL THEN detail END AS detail FROM {_AUDIT}"""),
)
def read_audit(spark, d):
    df = A.read_audit(audit_raw(spark, d))
    ok = F.col("reason").isNull()
    return df.select(
        "stream_id", "reason", F.when(ok, F.unix_micros("ts")).alias("ts_us"),
        F.when(ok, F.col("detail")).alias("detail"),
    )


@query(
    "a03_content_keys",
    """SELECT event_id, key_no % 4 < 2 OR key_no = 2 AS holds FROM (
    SELECT event_id, event_id % 8 AS key_no FROM events)""",
)
def content_keys(spark, d):
    """Forbidden names as keys at several depths, and as values only."""
    from ..functions.jsontext import holds_content, parsed

    i = F.col("event_id")
    bodies = (
        '{"a": [{"PROMPT": 1}]}', '{"content": null}', '{"x": {"y": {"evidence": []}}}',
        '{"a": "content"}', '[[{"Text": 0}]]', '{"te\\u0078t": 1}', '{"a\\"text": 1}',
        '{"texts": "prompt:", "b": ["text"]}',
    )
    v = parsed(T.pick(bodies, i))
    return T.events(spark, d).select("event_id", holds_content(v).alias("holds"))


@query(
    "a04_audit_rows_once",
    with_("ev", then=f"""SELECT DISTINCT event_id::VARCHAR AS stream_id, us AS ts_us,
    'tenant:' || slug AS actor, action, 'request:' || event_id AS resource, detail FROM {_AUDIT}
    WHERE reason IS NULL"""),
)
def audit_rows(spark, d):
    rows = A.audit_rows(A.read_audit(audit_raw(spark, d)))
    return rows.select("stream_id", F.unix_micros("ts").alias("ts_us"), "actor", "action",
                       "resource", "detail")


@query(
    "a04_audit_dead_letters",
    with_("ev", then=f"""SELECT reason, count(*) AS letters, count(DISTINCT CASE
    WHEN event_id % 13 = 0 THEN 1 WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 19 = 0 THEN 3
    WHEN event_id % 23 = 0 THEN 4 ELSE 5 + event_id % 5 END) AS details, FALSE AS holds_detail
    FROM {_AUDIT} WHERE reason IS NOT NULL GROUP BY reason"""),
)
def audit_dead_letters(spark, d):
    letters = A.audit_dead_letters(A.read_audit(audit_raw(spark, d)))
    return letters.groupBy("reason").agg(
        F.count(F.lit(1)).alias("letters"), F.countDistinct("detail_sha256").alias("details"),
        F.bool_or(F.map_contains_key("fields", "detail")).alias("holds_detail"),
    )


@query(
    "a05_guardrail_actions_per_day",
    with_("ev", then=f"""SELECT 'tenant:' || slug AS actor, strftime(ts, '%Y-%m-%d') AS day,
    count(*) FILTER (action = 'guardrail.pii_blocked') AS pii_blocked,
    count(*) FILTER (action = 'guardrail.pii_redacted') AS pii_redacted,
    count(*) FILTER (action = 'guardrail.injection_blocked') AS injection_blocked
    FROM (SELECT DISTINCT event_id, slug, ts, action FROM {_AUDIT} WHERE reason IS NULL)
    GROUP BY 1, 2"""),
)
def actions_per_day(spark, d):
    return A.action_counts(A.audit_rows(A.read_audit(audit_raw(spark, d))))


@query(
    "a06_audit_search",
    with_("ev", then=f"""SELECT DISTINCT event_id::VARCHAR AS stream_id FROM {_AUDIT}
    WHERE reason IS NULL AND slug = 'hr' AND action = 'guardrail.pii_blocked'"""),
)
def audit_search(spark, d):
    log = A.audit_rows(A.read_audit(audit_raw(spark, d)))
    return A.search(log, actor="tenant:hr", action="guardrail.pii_blocked").select("stream_id")


_EVENTS_OUT = """SELECT e.conv_id, 'tenant:' || slug AS actor, CASE action WHEN 'block'
    THEN 'guardrail.pii_blocked' ELSE 'guardrail.pii_redacted' END AS action,
    'request:' || e.conv_id AS resource, CASE action WHEN 'block'
    THEN '{"count": ' || redactions || ', "kinds": [' || k || ']}'
    ELSE '{"count": ' || redactions || ', "mode": "' || mode || '"}' END AS detail"""


@query(
    "a01_audit_events",
    with_("turns", "mapping", then=f"""{_EVENTS_OUT} FROM (
    SELECT t.conv_id, slug, mode, CASE mode WHEN 'block' THEN 'block' ELSE 'redact' END AS action,
      redactions, k FROM (SELECT DISTINCT conv_id, slug, mode FROM turns WHERE mode <> 'off') t
    JOIN (SELECT conv_id, count(*) AS redactions, string_agg(DISTINCT '"' || kind || '"', ', '
      ORDER BY '"' || kind || '"') AS k FROM mapping GROUP BY conv_id) m USING (conv_id)) e"""),
)
def audit_events(spark, d):
    from .privacy import decided

    blocked = F.col("action") == "block"
    detail = F.when(
        blocked, A.spaced_json(F.struct(F.col("redactions").alias("count"), "kinds"))
    ).otherwise(A.spaced_json(F.struct(F.col("redactions").alias("count"), "mode")))
    event = A.build_event(
        F.lit("1735689600"), F.col("slug"),
        F.when(blocked, "guardrail.pii_blocked").otherwise("guardrail.pii_redacted"),
        F.col("conv_id").cast("string"), F.lit(None).cast("string"), detail,
    )
    out = decided(spark, d).filter("action <> 'pass'").select("conv_id", event.alias("e"))
    return out.select(
        "conv_id", *[F.element_at("e", F.lit(n)).alias(n) for n in ("actor", "action", "resource", "detail")]
    )


