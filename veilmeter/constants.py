"""Patterns, word lists, limits and messages that results depend on.

Patterns are written for Java's regex engine with every character class spelled out, so that
their meaning does not depend on engine flags. ``W``, ``D`` and ``S`` are Unicode word, digit and
white-space characters; a keyword boundary is a look-around on ``W``.
"""

W = r"\p{L}\p{N}_"
D = r"\p{Nd}"
S = (
    r"\s\x1c-\x1f\x85\xa0"
    r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Characters a text field may carry around a value and that trimming removes.
BLANKS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# --- Fixed values: personal-data kinds in priority order -----------------------------------
PII_KINDS = ("CCCD", "PHONE", "EMAIL", "BANK", "ORDER", "NAME")
PROVINCE_FIRST, PROVINCE_LAST = 1, 96

# For each kind what must stand before the match (case as written), whether letter
# case is ignored, the context that belongs to the match, the value, what may not follow, and a
# pattern every text with a match contains. Look-behinds come after a first character or a
# look-ahead, so that nearly every position of a text fails on one comparison.
PII_PATTERNS = {
    "CCCD": {
        "value": rf"{D}(?<!{D}{D}){D}{{11}}",
        "after": rf"(?!{D})",
    },
    "PHONE": {
        "value": rf"[+0](?<!{D}[+0])(?:(?<=\+)84|(?<=0))[{S}.]?[35789](?:[{S}.]?{D}){{8}}",
        "after": rf"(?!{D})",
    },
    "EMAIL": {
        "before": rf"(?<![{W}.+-])",
        "fold": True,
        "value": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "after": rf"(?![{W}.-])",
        "gate": "@",
    },
    "BANK": {
        "before": rf"(?=[sStTnN\x{{17f}}][tTốỐàÀgG])(?<![{W}])",
        "fold": True,
        "context": rf"(?:stk|số[{S}]*tài[{S}]*khoản|tài[{S}]*khoản|ngân[{S}]*hàng)"
        rf"[{S}]*(?:là|:)?[{S}]*",
        "value": rf"{D}(?:[{S}.-]?{D}){{7,18}}",
        "gate": rf"{D}(?:[{S}.-]?{D}){{7}}",
    },
    "ORDER": {
        "before": rf"(?<![{W}])",
        "fold": True,
        "value": r"#[A-Za-z][A-Za-z0-9]{3,}",
        "after": rf"(?![{W}])",
        "gate": "#",
    },
    "NAME": {
        "before": rf"(?=[hHkK\x{{212a}}nNtT][ọỌhHgGêÊ])(?<![{W}])",
        "fold": True,
        "context": rf"(?:họ[{S}]*(?:và[{S}]*)?tên|khách[{S}]*hàng|người[{S}]*nhận|tên)"
        rf"[{S}]*[:\-]?[{S}]*",
        "value": rf"(?:nguyễn|trần|lê|phạm|hoàng|huỳnh|phan|vũ|võ|đặng|bùi|đỗ|hồ|ngô|dương|lý)"
        rf"[{S}]+(?:[a-zà-ỹđß\x{{1fd3}}\x{{1fe3}}\x{{a64a}}\x{{a64b}}]+[{S}]*){{1,4}}",
    },
}

PLACEHOLDER = rf"<[A-Z]+_{D}+>"
MAX_PLACEHOLDER = 16
MASK_OTHER = "[ĐÃ CHE]"
PII_MODES = ("redact", "mask", "block", "off")

# Fixed value: phone pattern of the payload leak scan.
LEAK_PHONE = rf"[+0](?<!{D}[+0])(?:(?<=\+)84|(?<=0))(?:[{S}.]?{D}){{9}}(?!{D})"

# --- Fixed values: prompt-injection rules in reporting order -------------------------------
INJECTION_RULES = (
    (
        "ignore_previous_instructions",
        rf"(?=[iI\x{{130}}\x{{131}}dDbB][gGiI\x{{130}}\x{{131}}ỏỎ])(?<![{W}])(?iu)(?:ignore|disregard|bỏ[{S}]*qua)(?![{W}])[^\n]{{0,50}}"
        rf"(?<![{W}])(?:previous|prior|hướng[{S}]*dẫn|chỉ[{S}]*dẫn)(?![{W}])",
    ),
    (
        "reveal_system_prompt",
        rf"(?=[rRsS\x{{17f}}pPtThH][eEhHrRiI\x{{130}}\x{{131}}])(?<![{W}])(?iu)(?:reveal|show|print|tiết[{S}]*lộ|hiển[{S}]*thị)(?![{W}])[^\n]{{0,50}}"
        rf"(?<![{W}])(?:system[{S}]*prompt|prompt[{S}]*hệ[{S}]*thống|instructions)(?![{W}])",
    ),
    (
        "role_override",
        rf"(?=[yYaAtTđĐ][oOcCừỪóÓ])(?<![{W}])(?iu)(?:you[{S}]+are[{S}]+now|act[{S}]+as|từ[{S}]*giờ[{S}]*bạn[{S}]*là|"
        rf"đóng[{S}]*vai)(?![{W}])",
    ),
    ("delimiter_escape", r"(?=[<`\[])(?iu)(?:</?system>|```system|\[\[system\]\])"),
)
EVIDENCE_CHARS = 160
INJECTION_MODES = ("off", "block")

# --- Fixed values: routing, quota, metering, audit -------------------------------------------
LEVELS = ("public", "internal", "confidential", "restricted")
LOCAL_ONLY_LABELS = ("confidential", "restricted")
LABEL_HEADER = "x-context-label"
RESIDENCY = ("any", "local_only")

WINDOW_SECONDS = 60
DEFAULT_MAX_TOKENS = 256
TOKEN_FIELDS = ("input", "messages", "prompt", "system", "tools")
MAPPING_TTL_SECONDS = 300

ENDPOINTS = {"aembedding": "/v1/embeddings", "anthropic_messages": "/v1/messages"}
DEFAULT_ENDPOINT = "/v1/chat/completions"
FORBIDDEN_AUDIT_KEYS = ("prompt", "content", "text", "evidence")

USAGE_FIELDS = (
    "call_id", "trace_id", "team_id", "team_alias", "key_hash", "key_alias", "model_group",
    "model", "call_type", "tokens_in", "tokens_out", "cost_usd", "cache_hit", "stream",
    "start_time", "end_time",
)

# Refusal messages stored with dead letters.
MSG_MISSING = "Thiếu "
MSG_NOT_INT = " phải là số nguyên"
MSG_NEGATIVE = " không được âm"
MSG_NOT_NUMBER = " phải là số"
MSG_INVALID = " không hợp lệ"
MSG_TEAM = "team_id phải là UUID tenant"
MSG_END_NOT_TS = "start_time không phải timestamp"
MSG_END_INVALID = "start_time không hợp lệ"
MSG_LATENCY = "timestamp không hợp lệ"
MSG_AUDIT_TS = "ts không hợp lệ"
MSG_AUDIT_JSON = "detail không phải JSON"
MSG_AUDIT_OBJECT = "detail phải là JSON object"
MSG_AUDIT_CONTENT = "detail không được chứa nội dung request"
