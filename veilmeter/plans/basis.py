"""Common table expressions the reference SQL builds on: the derived tables, stated as formulas."""

from __future__ import annotations

from ..sources.tables import CALL_TYPES, MODELS, TENANTS


def choose(options, index: str) -> str:
    arms = " ".join(
        f"WHEN {n} THEN " + ("NULL" if o is None else f"'{o}'" if isinstance(o, str) else str(o))
        for n, o in enumerate(options)
    )
    return f"CASE ({index}) % {len(options)} {arms} END"


def money(micros: str) -> str:
    return f"(({micros})::DECIMAL(18,6) / 1000000)"


_T = [t[0] for t in TENANTS]
_ID = [t[1] for t in TENANTS]
_M = [m[0] for m in MODELS]

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        f"""SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS us,
        {choose(_T, 'user_id')} AS slug, {choose(_ID, 'user_id')} AS tenant_id,
        {choose(_M, 'event_id')} AS model, 1 + event_id % 500 AS tokens_in,
        1 + event_id % 200 AS tokens_out,
        CASE event_id % 3 WHEN 0 THEN 1 + event_id % 500 + 5 * (1 + event_id % 200) WHEN 1 THEN 0
        ELSE 2 * (1 + event_id % 500) + 10 * (1 + event_id % 200) END AS cost_micros,
        {choose(CALL_TYPES, 'event_id')} AS call_type FROM events""",
    ),
    "usage": (
        ("ev",),
        """SELECT *, CASE WHEN event_id % 97 = 0 THEN 'team_id phải là UUID tenant'
        WHEN event_id % 83 = 0 THEN 'Thiếu model'
        WHEN event_id % 89 = 0 THEN 'tokens_in không được âm' END AS reason,
        CASE call_type WHEN 'aembedding' THEN '/v1/embeddings'
        WHEN 'anthropic_messages' THEN '/v1/messages' ELSE '/v1/chat/completions' END AS endpoint,
        event_id % 2000 AS latency_ms, event_type = 'view' AS cache_hit,
        CASE WHEN event_id % 3 = 0 THEN 'call-' ELSE 'trace-' END || event_id AS trace_id
        FROM ev""",
    ),
    "facts": (("usage",), "SELECT * FROM usage WHERE reason IS NULL"),
    "tenants": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{s}', '{i}', '{r}', {b}, {w}, {rpm}, {tpm})"
                    for s, i, r, b, w, rpm, tpm, _ in TENANTS)
        + ") t(slug, tenant_id, data_residency, budget_usd, warning_usd, rpm, tpm)",
    ),
    "allowed": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{t[0]}', '{t[1]}', '{m}')" for t in TENANTS for m in t[7])
        + ") t(slug, tenant_id, model)",
    ),
    "catalog": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{i}', '{p}', '{t}', {a}, {b}, '{r}')" for i, p, t, a, b, r in MODELS)
        + ") t(id, provider, tier, price_in, price_out, residency)",
    ),
    "turns": (
        (),
        f"""SELECT conv_id, turn, role, text, {choose(_T, 'conv_id')} AS slug,
        {choose(_ID, 'conv_id')} AS tenant_id,
        {choose(('redact', 'mask', 'block', 'off', 'redact'), 'conv_id')} AS mode,
        (conv_id % 5 IN (0, 4)) AND conv_id % 7 NOT IN (0, 6) AS restore FROM conversations""",
    ),
    "known": (
        ("turns",),
        """SELECT *, '09' || lpad((conv_id + CASE WHEN turn % 4 = 2 THEN 5000000 ELSE 0 END)::VARCHAR,
        8, '0') AS phone, '001' || lpad(conv_id::VARCHAR, 9, '0') AS cccd,
        (10000000 + conv_id)::VARCHAR AS bank, '#A' || (1000 + conv_id) AS ord,
        'Nguyễn Văn An' AS name, 'khach' || conv_id || '@example.com' AS email
        FROM turns WHERE turn % 2 = 0""",
    ),
    # One row per written value with its position in the text.
    "ents": (
        ("known",),
        """SELECT conv_id, turn, slug, mode, restore, k.no AS entity_no, k.kind, k.value,
        (length(text) + k.gap)::BIGINT AS start_at, (length(text) + k.gap + length(k.value))::BIGINT AS end_at
        FROM (SELECT *, unnest([
          {'no': 0, 'kind': 'PHONE', 'value': phone, 'gap': 5},
          {'no': 1, 'kind': 'CCCD', 'value': cccd, 'gap': 5 + length(phone) + 7},
          {'no': 2, 'kind': 'BANK', 'value': bank, 'gap': 5 + length(phone) + 7 + 12 + 7},
          {'no': 3, 'kind': 'ORDER', 'value': ord, 'gap': 5 + length(phone) + 26 + length(bank) + 6},
          {'no': 4, 'kind': 'NAME', 'value': name,
           'gap': 37 + length(phone) + length(bank) + length(ord) + 14},
          {'no': 5, 'kind': 'EMAIL', 'value': email,
           'gap': 51 + length(phone) + length(bank) + length(ord) + 13 + 2}]) AS k FROM known)""",
    ),
    "firsts": (
        ("ents",),
        """SELECT conv_id, kind, value, min(turn) AS first_turn FROM ents
        GROUP BY conv_id, kind, value""",
    ),
    "mapping": (
        ("firsts",),
        """SELECT conv_id, kind, value AS original,
        row_number() OVER (PARTITION BY conv_id, kind ORDER BY first_turn) AS n FROM firsts""",
    ),
}


def with_(*names: str, then: str) -> str:
    """``then`` preceded by the named parts and whatever they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in PARTS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + then
