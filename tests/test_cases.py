"""Known cases for record readers, policies, masking, crypto and requests."""

import json

import pytest
from pyspark.sql import functions as F

from veilmeter.functions import crypto, jsontext, pii
from veilmeter.functions.requests import request_fields, untrusted_text
from veilmeter.functions.spans import Recogniser
from veilmeter.operators import audit, evaluation, metering, quota, routing

TEAM = "3edc0d7b-5f10-5295-bb88-fbe0d4d324f9"
GOOD = {"call_id": "c", "team_id": TEAM, "model": "m", "call_type": "aembedding", "tokens_in": "24",
        "tokens_out": "11", "cost_usd": "7.9e-05", "cache_hit": "True", "start_time": "1735689600.0",
        "end_time": "1735689600.125"}


def read(spark, *records):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(records)], "stream_id string, fields map<string,string>")
    return metering.read_usage(df).orderBy(F.col("stream_id").cast("int")).collect()


def test_a_good_record(spark):
    r = read(spark, GOOD)[0]
    assert (r.reason, r.tenant_id, r.latency_ms, r.endpoint, r.trace_id) == (None, TEAM, 125, "/v1/embeddings", "c")
    assert (str(r.cost_usd), r.cache_hit, r.tokens_in) == ("0.000079", True, 24)


@pytest.mark.parametrize(
    ("change", "reason"),
    [({"team_id": "cskh"}, "team_id phải là UUID tenant"), ({"team_id": None}, "team_id phải là UUID tenant"),
     ({"end_time": None}, "Thiếu end_time"), ({"end_time": "x"}, "start_time không phải timestamp"),
     ({"end_time": "0"}, "start_time không hợp lệ"), ({"end_time": "nan"}, "start_time không hợp lệ"),
     ({"model": " "}, "Thiếu model"), ({"tokens_in": "-1"}, "tokens_in không được âm"),
     ({"tokens_in": ""}, "tokens_in phải là số nguyên"), ({"tokens_out": "1.0"}, "tokens_out phải là số nguyên"),
     ({"tokens_out": "1_0"}, "tokens_out phải là số nguyên"), ({"cost_usd": "x"}, "cost_usd phải là số"),
     ({"cost_usd": "-1"}, "cost_usd không hợp lệ"), ({"cost_usd": "NaN"}, "cost_usd không hợp lệ"),
     ({"start_time": None}, "timestamp không hợp lệ"), ({"call_id": " "}, "Thiếu call_id"),
     ({"tokens_in": None, "cost_usd": None}, None), ({"tokens_in": " ١٢ "}, None),
     ({"team_id": "{" + TEAM.replace("-", "").upper() + "}"}, None), ({"trace_id": " "}, None)],
)
def test_refusals(spark, change, reason):
    record = {k: v for k, v in {**GOOD, **change}.items() if v is not None}
    assert read(spark, record)[0].reason == reason


def test_half_milliseconds_round_to_even(spark):
    rows = read(spark, {**GOOD, "start_time": "0.5", "end_time": "0.5025"}, {**GOOD, "start_time": "9", "end_time": "8"})
    assert [r.latency_ms for r in rows] == [2, 0]


@pytest.mark.parametrize(
    ("detail", "reason"),
    [('{"count":2,"mode":"redact"}', None), ('{"prompt":"raw"}', "detail không được chứa nội dung request"),
     ('{"metrics":{"text":"raw"}}', "detail không được chứa nội dung request"),
     ("[]", "detail phải là JSON object"), ("{", "detail không phải JSON"), ("", "Thiếu detail")],
)
def test_audit_records(spark, detail, reason):
    fields = {"ts": "1735689600", "actor": "tenant:cskh", "action": "a", "resource": "request:r", "detail": detail}
    df = spark.createDataFrame([("1", fields)], "stream_id string, fields map<string,string>")
    assert audit.read_audit(df).first().reason == reason


def test_token_estimates(spark):
    bodies = [
        {"messages": [{"role": "user", "content": 'Xin chào, "bạn": a,b:c\\ \n😀'}], "max_tokens": "12"},
        {"prompt": "x", "max_tokens": -3}, {"input": ["a", "b"], "max_tokens": True}, {}, {"max_tokens": 2.7},
        {"max_tokens": 0, "system": ""}, {"max_tokens": "z", "tools": [{"b": 1, "a": {}}]}, {"messages": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, b string")
    got = {r.i: r.n for r in df.select("i", jsontext.request_tokens(F.col("b")).alias("n")).collect()}
    # A quarter of the characters of the prompt fields as sorted JSON, rounded up, plus the answer's limit.
    assert [got[i] for i in range(len(bodies))] == [32, 4, 7, 257, 3, 260, 264, 257]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_mask_and_custom_recogniser(spark):
    masked = one(spark, "SĐT 0912345678, a lan@example.com, STK 123456789012", pii.mask(F.col("t")))
    assert masked == "SĐT ***678, a l***@example.com, STK ***012"
    tickets = (Recogniser("TICKET", value="T-[0-9]+", context="phiếu ", before="(?<![a-z])"),)
    found = one(spark, "phiếu T-12, T-13", pii.entities(F.col("t"), tickets))
    assert [(e.kind, e.value, e.start, e.end) for e in found] == [("TICKET", "T-12", 6, 10)]


def test_repeated_values_keep_their_number(spark):
    text = "Nhắn 0987123456 về đơn #B7712, rồi nhắn 0987123456 lần nữa"
    df = spark.createDataFrame([(text,)], "t string").withColumn("e", pii.entities(F.col("t")))
    df = df.withColumn("n", pii.numbering(F.col("e")))
    r = df.select(pii.redact_texts(F.array("t"), F.array("e"), F.col("n"))[0].alias("r"),
                  pii.request_mapping(F.col("n")).alias("m"))
    r = r.withColumn("back", pii.restore(F.col("r"), F.col("m"))).first()
    assert r.r == "Nhắn <PHONE_1> về đơn <ORDER_1>, rồi nhắn <PHONE_1> lần nữa" and r.back == text
    assert r.m == {"<PHONE_1>": "0987123456", "<ORDER_1>": "#B7712"}


def test_request_texts(spark):
    body = json.dumps({
        "model": "ignored", "system": "s", "input": ["skipped"], "prompt": [{"type": "text", "text": "p"}],
        "messages": [{"role": "user", "content": "a"}, {"content": [{"text": "b"}, {"text": 1}, "x", {"text": "c"}]},
                     "odd", {"role": "tool"}],
    })
    fields = one(spark, body, request_fields(F.col("t")))
    assert [(f.field, f.part, f.text) for f in fields] == [(0, 0, "a"), (1, 0, "b"), (1, 3, "c"), (4, 0, "s"), (6, 0, "p")]
    assert one(spark, body, untrusted_text(F.col("t"))).split("\n") == ["a", "b", "x", "c", "odd", "s", "skipped", "p"]


def test_sealed_values_are_bound_to_their_name(spark):
    key = "0f" * 32
    sealed = crypto.seal(F.col("t"), key, F.lit("map:1"))
    assert one(spark, "v", crypto.open_sealed(sealed, key, F.lit("map:1"))) == "v"
    assert one(spark, "v", crypto.open_sealed(sealed, key, F.lit("map:2"))) is None
    with pytest.raises(ValueError):
        crypto.checked_key("0f")


def test_only_service_keys_are_believed(spark):
    headers = F.create_map(F.lit("x-context-label"), F.lit(" Restricted "))
    for metadata, label in (('{"service": true}', "restricted"), ('{"service": "true"}', None), (None, None)):
        assert one(spark, metadata, routing.trusted_label(headers, F.col("t"))) == label


def test_rate_policies(spark):
    cases = [('{"tenant":"a","rpm_limit":60,"tpm_limit":"9"}', "active"), ('{"tenant":"a","rpm_limit":60}', "none"),
             ('{"tenant":"a","rpm_limit":0,"tpm_limit":9}', "invalid"), ('{"tenant":"a","rpm_limit":true,"tpm_limit":9}', "invalid"),
             ('{"tenant":1,"rpm_limit":6,"tpm_limit":9}', "none"), (None, "none")]
    df = spark.createDataFrame([(m,) for m, _ in cases], "metadata string")
    assert [r.policy for r in quota.rate_policy(df).collect()] == [p for _, p in cases]


def test_the_published_corpus_is_found_completely(spark):
    """80 cases of four kinds, 40 of two, 100 negatives: precision and recall 1, nothing leaks."""
    cases = evaluation.labelled_corpus(spark.range(100), "id")
    cases = cases.filter(F.col("id") < F.when(F.col("case_no") < 4, 80).when(F.col("case_no") < 6, 40).otherwise(100))
    rows = {r.kind: r for r in evaluation.confusion(evaluation.case_outcomes(cases)).collect()}
    assert cases.count() == 500 and len(rows) == 6
    assert all((r.precision, r.recall, r.false_positive) == (1.0, 1.0, 0) for r in rows.values())
    assert [rows[k].samples for k in ("PHONE", "CCCD", "BANK", "EMAIL", "ORDER", "NAME")] == [80] * 4 + [40] * 2
    assert evaluation.leakage(cases).filter("leaks").count() == 0


def test_sections_of_long_texts(spark):
    """Headings nest and close; many headings and many lines stay linear."""
    from veilmeter.operators.retrieval import sections

    lines = [("#" * (i * 7 % 6 + 1) + f" h{i}") if i % 3 == 0 else f"line {i}" for i in range(1500)]
    out, open_, body = [], [], []
    for line in lines:
        if line.startswith("#"):
            out.append((" › ".join(t for _, t in open_), "\n".join(body)))
            level, title = len(line.split(" ")[0]), line.split(" ")[1]
            open_, body = [h for h in open_ if h[0] < level] + [(level, title)], []
        else:
            body.append(line)
    out.append((" › ".join(t for _, t in open_), "\n".join(body)))
    df = spark.createDataFrame([("\n".join(lines),), ("",), (None,)], "t string")
    got = [r.s for r in df.select(sections(df.t).alias("s")).collect()]
    assert [tuple(x) for x in got[0]] == out and [tuple(x) for x in got[1]] == [("", "")]


def test_a_policy_document_is_parsed_once(spark):
    """Every rule and branch reads values of one parse; the rules say what they said."""
    from veilmeter.operators import policies

    good = ('{"version": 1, "tenant": {"id": "3edc0d7b-5f10-5295-bb88-fbe0d4d324f9", "slug": "t", "data_residency": "any"}, '
            '"limits": {"monthly_budget_usd": 5, "warning_budget_usd": 4, "rpm": 6.5, "tpm": "7"}, "models": {"allow": ["m"]}, '
            '"guardrails": {"pii": "redact", "pii_restore": true, "injection": "block"}}')
    odd = good.replace('"rpm": 6.5', '"rpm": 0.5').replace('"t"', "null").replace("[\"m\"]", "7").replace(": 4", ": 6")
    df = policies.check_policies(spark.createDataFrame([(1, good), (2, odd), (3, "no JSON"), (4, None)], "id int, spec string"))
    assert df.columns == ["id", "spec", "broken"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    rows = {r.id: r.broken for r in df.collect()}
    assert rows[1] == [] and rows[2] == ["tenant.slug", "models.allow", "limits.rpm", "limits.warning"]
    assert rows[3] == rows[4] and len(rows[3]) == 15


def test_only_marked_pieces_go_to_python(spark):
    """NFC of texts whose marks follow any character; what lies between pieces stays in the JVM."""
    import unicodedata

    from veilmeter.operators import retrieval

    texts = ["tie\u0302\u0301ng a\n\u0301b", "\u0301x", "e\u0301", "\u1100\u1161\u11a8 한", "Å \u212b 𝒳\u0302", "a\U0001d15eb", "plain", "", None]
    df = retrieval.normalise(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    assert {r.id: r.text for r in df.collect()} == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    assert "regexp_extract_all" in df._jdf.queryExecution().optimizedPlan().toString()


def test_every_refusal_reads_the_records_once(spark, sf_dir):
    from veilmeter.plans import metering as plans

    plan = plans.every_refusal(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_pairs_below_the_limit_are_not_judged():
    """Where no pair reaches the limit nothing else is worked out; one that does is found, whichever way."""
    import numpy as np
    import pandas as pd

    from veilmeter.operators import vectors

    asked = []

    def allowed(left, rows):
        asked.append(len(rows))
        return left["id"].to_numpy()[:, None] < rows["id"].to_numpy()[None, :]

    def block(x):
        return pd.DataFrame({"t": "t", "id": np.arange(len(x)), "vector": list(x)})

    far, same = block(np.eye(300)), block(np.ones((300, 4)))
    join = vectors._meeting(allowed, 1, 0.95, ["t"])
    assert join(far, far.assign(vector=list(-np.eye(300)))).empty and not asked
    assert join(far, far).empty and sum(asked) == 300
    found = join(same, same)
    assert found["left_id"].tolist() == [0] * 299 and found["right_id"].tolist() == list(range(1, 300))
