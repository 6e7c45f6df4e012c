"""Document, retrieval, cache and agent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents as X
from ..operators import cache as C
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import text_index as P
from ..operators import vector_index as I
from ..operators import vector_links as L
from ..session import durable
from ..sources import tables as T
from .basis import choose, with_
from .registry import query

_GROUPS = ("nhan-vien", "quan-ly", "ke-toan")
_TENANT_IDS = [t[1] for t in T.TENANTS]


@query(
    "ra_unicode_nfc",
    """SELECT doc_id, length(t)::BIGINT AS chars, sha256(t) AS digest FROM (SELECT doc_id, nfc_normalize(
    text || CASE WHEN doc_id % 2 = 0 THEN ' tie' || chr(770) || chr(769) || 'ng' ELSE '' END) AS t
    FROM documents)""",
)
def unicode_nfc(spark, d):
    """Every second text gains a decomposed word."""
    word = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit(" tie\u0302\u0301ng")).otherwise("")
    out = R.normalise(T.read(spark, d, "documents").withColumn("text", F.concat("text", word)))
    return out.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def headed_documents(spark, d):
    """Documents between headings of three levels; lines that look like headings are prefixed."""
    body = F.regexp_replace("text", "(?m)^#", "/#")
    text = F.concat(
        F.lit("lời mở\n# Tài liệu "), F.col("doc_id").cast("string"), F.lit("\n"), body,
        F.lit("\n## Phần hai \n"), body, F.lit("\n### Mục\n"), F.col("source"), F.lit("\n## Cuối\n \nhết"),
    )
    return T.read(spark, d, "documents").select("doc_id", text.alias("text"))


_WORDS = r"string_split_regex(regexp_replace(b, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), '[ \t\n\r\f\x0B]+')"


@query(
    "rb_chunks_by_heading",
    rf"""WITH d AS (SELECT doc_id, source, regexp_replace(text, '(^|\n)#', '\1/#', 'g') AS b FROM documents),
    s AS (SELECT doc_id, 0 AS section_no, '' AS heading_path, ['lời', 'mở'] AS w FROM d
      UNION ALL SELECT doc_id, 1, 'Tài liệu ' || doc_id, {_WORDS} FROM d
      UNION ALL SELECT doc_id, 2, 'Tài liệu ' || doc_id || ' › Phần hai', {_WORDS} FROM d
      UNION ALL SELECT doc_id, 3, 'Tài liệu ' || doc_id || ' › Phần hai › Mục', [source] FROM d
      UNION ALL SELECT doc_id, 4, 'Tài liệu ' || doc_id || ' › Cuối', ['hết'] FROM d),
    n AS (SELECT *, greatest(len(w) // 400 - 1, 0) AS last FROM s WHERE array_to_string(w, '') <> ''),
    c AS (SELECT *, unnest(range(0, last + 1)) AS i FROM n)
    SELECT doc_id, section_no::BIGINT AS section_no, i::BIGINT AS chunk_no, heading_path,
      len(p)::BIGINT AS n_words, sha256(array_to_string(p, ' ')) AS digest FROM (
      SELECT *, CASE WHEN i = last THEN w[i * 400 + 1:] ELSE w[i * 400 + 1:i * 400 + 470] END AS p FROM c)""",
)
def chunks_by_heading(spark, d):
    out = R.chunk(headed_documents(spark, d), ["doc_id"])
    return out.select("doc_id", "section_no", "chunk_no", "heading_path", "n_words",
                      F.sha2("content", 256).alias("digest"))


@query(
    "rc_current_versions",
    """SELECT o_custkey AS document_id, max(o_orderkey) AS version FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def current_versions(spark, d):
    docs = T.read(spark, d, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") != "P", "ready").otherwise("indexing").alias("status"),
    )
    return R.current_versions(docs, "document_id").select("document_id", "version")


def vector_chunks(spark, d):
    v = F.col("vec_id")
    return T.read(spark, d, "embeddings").select(
        T.pick(_TENANT_IDS, v).alias("tenant_id"), v.alias("id"), F.col("embedding").alias("vector"),
        F.array(T.pick(_GROUPS, F.col("label"))).alias("acl_groups"),
        (F.pmod(v, F.lit(17)) == 0).alias("quarantined"), "label",
    )


def questions(spark, d):
    """One question per label and tenant: the vector of the label's newest chunk."""
    c = vector_chunks(spark, d)
    newest = c.groupBy("tenant_id", "label").agg(F.max_by("vector", "id").alias("vector"))
    place = F.element_at(F.create_map(*[x for n, t in enumerate(_TENANT_IDS) for x in (F.lit(t), F.lit(n))]), F.col("tenant_id"))
    return newest.select(
        "tenant_id", (F.col("label") * 3 + place).cast("bigint").alias("id"), "vector",
        F.array(F.lit("ke-toan"), T.pick(_GROUPS, F.col("label"))).alias("groups"),
    )


_VECTOR = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.vec_id AS chunk_id,
      round(list_cosine_similarity(c.embedding::DOUBLE[], q.vector::DOUBLE[]), 9) AS score
    FROM embeddings c JOIN (SELECT label * 3 + vec_id % 3 AS query_id, label, vec_id % 3 AS t,
      arg_max(embedding, vec_id) AS vector FROM embeddings GROUP BY ALL) q ON q.t = c.vec_id % 3
    WHERE c.vec_id % 17 <> 0 AND c.label % 3 IN (2, q.label % 3)))"""


def vector_branch(spark, d):
    return R.vector_branch(vector_chunks(spark, d), questions(spark, d))


@query(
    "rd_vector_branch",
    f"""SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) AS score, rank FROM {_VECTOR}
    WHERE rank <= 40""",
)
def vectors_top(spark, d):
    return vector_branch(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_index(spark, d, cells: int = 32) -> str:
    """The stored index of all vectors; its path."""
    path = P.new_path(spark)
    I.build(vector_chunks(spark, d), path, cells)
    return path


@query(
    "rd_index_every_cell",
    f"""SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) AS score, rank FROM {_VECTOR}
    WHERE rank <= 40""",
)
def index_every_cell(spark, d):
    """The exact way through the index: every cell of a question's tenant is read."""
    found = I.search(spark, vector_index(spark, d), questions(spark, d), probes=None)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("rd_index_recall")
def index_recall(spark, d):
    """Share of the exact answers that the nearest cells alone give, and of the rows they read."""
    path, asked = vector_index(spark, d), durable(questions(spark, d))
    found = durable(I.search(spark, path, asked))
    ways = [I.probed(spark, path, asked, 40, probes).select("tenant_id", "cell", F.lit(name).alias("way"))
            for name, probes in (("near", I.PROBES), ("all", None))]
    read = ways[0].unionByName(ways[1]).join(spark.read.parquet(f"{path}/sizes"), ["tenant_id", "cell"]).groupBy(F.lit(1).alias("one")).agg(
        F.round(F.sum(F.when(F.col("way") == "near", F.col("n"))) / F.sum(F.when(F.col("way") == "all", F.col("n"))), 6).alias("share_read")
    )
    result = I.recall(found, I.search(spark, path, asked, probes=None)).withColumn("one", F.lit(1))
    return result.join(read, "one").drop("one")


def text_chunks(spark, d):
    i = F.col("doc_id")
    return T.read(spark, d, "documents").select(
        T.pick(_TENANT_IDS, F.floor(i / 3)).alias("tenant_id"), i.alias("id"), F.col("text").alias("content"),
        F.array(T.pick(_GROUPS, i)).alias("acl_groups"), (F.pmod(i, F.lit(17)) == 0).alias("quarantined"),
    )


# Two words per language that its texts use.
QUESTIONS = (("en", "the of"), ("fr", "le de"), ("de", "der und"), ("es", "de el"))


def text_questions(spark, d):
    """A question per language and tenant that has documents in it."""
    asked = spark.createDataFrame(list(QUESTIONS), "lang string, question string")
    no = F.element_at(F.create_map(*[x for n, (k, _) in enumerate(QUESTIONS) for x in (F.lit(k), F.lit(n))]), F.col("lang"))
    place = F.element_at(F.create_map(*[x for n, t in enumerate(_TENANT_IDS) for x in (F.lit(t), F.lit(n))]), F.col("tenant_id"))
    docs = T.read(spark, d, "documents").select(
        "lang", T.pick(_TENANT_IDS, F.floor(F.col("doc_id") / 3)).alias("tenant_id")
    )
    return docs.distinct().join(F.broadcast(asked), "lang").select(
        "tenant_id", (no * 3 + place).cast("bigint").alias("id"), "question",
        F.array(F.lit("ke-toan"), F.lit("quan-ly")).alias("groups"),
    )


_KEYWORD = r"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.doc_id AS chunk_id, (len(list_filter(c.w, lambda x: x = q.a))
      + len(list_filter(c.w, lambda x: x = q.b)))::BIGINT AS score
    FROM (SELECT doc_id, (doc_id // 3) % 3 AS t, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w
      FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 3 IN (1, 2)) c
    JOIN (SELECT DISTINCT n * 3 + (doc_id // 3) % 3 AS query_id, (doc_id // 3) % 3 AS t, a, b FROM documents
      JOIN (VALUES ('en', 0, 'the', 'of'), ('fr', 1, 'le', 'de'), ('de', 2, 'der', 'und'),
        ('es', 3, 'de', 'el')) v(lang, n, a, b) USING (lang)) q ON q.t = c.t
    WHERE list_contains(c.w, q.a) AND list_contains(c.w, q.b)))"""


def keyword_branch(spark, d):
    asked = text_questions(spark, d)
    index = R.term_table(text_chunks(spark, d), only=R.asked_terms(asked))
    return R.keyword_branch(index, asked)


@query(
    "re_keyword_branch",
    f"""SELECT query_id::BIGINT AS query_id, chunk_id, score, rank FROM {_KEYWORD} WHERE rank <= 40""",
)
def keywords_top(spark, d):
    return keyword_branch(spark, d)


# Two words cover each other where they follow one another in the text without the same word between.
_DENSITY = r"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (pos - before)), 9) AS score FROM (
      SELECT query_id, chunk_id, w, pos, lag(w) OVER o AS word_before, lag(pos) OVER o AS before FROM (
        SELECT q.query_id, c.doc_id AS chunk_id, w, pos, q.a, q.b FROM (
          SELECT doc_id, (doc_id // 3) % 3 AS t, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
            SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
            FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 3 IN (1, 2))) c
        JOIN (SELECT DISTINCT n * 3 + (doc_id // 3) % 3 AS query_id, (doc_id // 3) % 3 AS t, a, b FROM documents
          JOIN (VALUES ('en', 0, 'the', 'of'), ('fr', 1, 'le', 'de'), ('de', 2, 'der', 'und'),
            ('es', 3, 'de', 'el')) v(lang, n, a, b) USING (lang)) q ON q.t = c.t AND c.w IN (q.a, q.b))
      WINDOW o AS (PARTITION BY query_id, chunk_id ORDER BY pos)) WHERE w <> word_before GROUP BY 1, 2))"""


@query(
    "re_ranked_search",
    f"""SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) AS score, rank FROM {_DENSITY} WHERE rank <= 40""",
)
def ranked_search(spark, d):
    """Keyword search by cover density over the stored index, the blocks that cannot win left unread."""
    path = P.new_path(spark)
    P.build(text_chunks(spark, d), path)
    found, _ = P.search(spark, path, text_questions(spark, d))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_FUSED = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS score FROM (
      SELECT query_id, chunk_id, rank FROM {_VECTOR} WHERE rank <= 40
      UNION ALL SELECT query_id, chunk_id, rank FROM {_KEYWORD} WHERE rank <= 40) GROUP BY ALL))"""


def fused(spark, d):
    return R.fuse(vector_branch(spark, d), keyword_branch(spark, d))


@query(
    "rf_rank_fusion",
    f"SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) AS score, rank FROM {_FUSED}",
)
def rank_fusion(spark, d):
    return fused(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    "rg_answer_context",
    f"""SELECT query_id::BIGINT AS query_id, chunk_id, rank, max(score) OVER (PARTITION BY query_id)
      < 0.0165 AS refused FROM {_FUSED} WHERE rank <= 6""",
)
def answer_context(spark, d):
    return R.answer_context(fused(spark, d), 0.0165).select("query_id", "chunk_id", "rank", "refused")


@query(
    "e07_retrieval_quality",
    # Golden sources of a question: chunks of its own label.
    f"""WITH g AS (SELECT DISTINCT label * 3 + vec_id % 3 AS query_id, vec_id AS chunk_id FROM embeddings
      WHERE vec_id % 17 <> 0)
    SELECT count(*) AS queries, round(avg(recall), 6) AS recall_at_k, round(avg(rr), 6) AS mrr FROM (
      SELECT query_id, count(*) FILTER (rank <= 6) / count(*) AS recall, coalesce(max(1 / rank), 0) AS rr
      FROM g LEFT JOIN (SELECT query_id, chunk_id, rank FROM {_VECTOR} WHERE rank <= 40)
      USING (query_id, chunk_id) GROUP BY query_id)""",
)
def retrieval_quality(spark, d):
    place = F.pmod("id", F.lit(3))
    golden = R.visible_chunks(vector_chunks(spark, d)).select(
        (F.col("label") * 3 + place).alias("query_id"), F.col("id").alias("doc_id")
    )
    ranked = vector_branch(spark, d).withColumnRenamed("chunk_id", "doc_id")
    return E.retrieval_quality(ranked, golden)


def near_copies(spark, d):
    """Each vector, a damped variant of it and, for every tenth, an exact copy.

    Damping the first coordinates lowers the cosine to the original by a known amount.
    """
    v = F.col("vec_id")
    damped = F.transform(
        "embedding", lambda x, i: F.when(i < F.pmod(v, F.lit(24)), x * F.lit(0.25).cast("float")).otherwise(x)
    )
    copy = F.when(F.pmod(v, F.lit(10)) == 0, F.col("embedding"))
    return T.read(spark, d, "embeddings").select(
        v, F.posexplode(F.array_compact(F.array(F.col("embedding"), damped, copy))).alias("n", "vector")
    ).select(
        (v * 3 + F.col("n")).alias("id"), "vector", F.pmod(v, F.lit(3)).alias("collection"),
        T.pick(_TENANT_IDS, v).alias("tenant_id"), (v * 2 + F.col("n") % 2).alias("document_id"),
    )


_COPIES = """(SELECT vec_id * 3 + n AS id, vec_id % 3 AS collection, vec_id * 2 + n % 2 AS document_id,
    CASE n WHEN 1 THEN list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 24
      THEN x * 0.25::FLOAT ELSE x END) ELSE embedding END AS vector FROM embeddings,
    (SELECT unnest([0, 1, 2]) AS n) WHERE n < 2 OR vec_id % 10 = 0)"""


@query(
    "rh_conflict_candidates",
    f"""WITH o AS (SELECT collection, vector, min(id) AS id, min(document_id) AS lo, max(document_id) AS hi
      FROM {_COPIES} GROUP BY collection, vector)
    SELECT a.collection, b.id AS chunk_id, a.id AS similar_id,
      round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS score
    FROM o a JOIN o b ON a.collection = b.collection
      AND NOT (a.lo = b.lo AND a.hi = b.lo AND b.hi = b.lo)
    WHERE round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) >= 0.85""",
)
def conflicts(spark, d):
    return R.conflict_candidates(near_copies(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "rh_similar_groups",
    f"""WITH RECURSIVE copies AS {_COPIES},
    o AS (SELECT collection, vector, min(id) AS id FROM copies GROUP BY collection, vector),
    links AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON a.collection = b.collection AND a.id <> b.id
      WHERE round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) >= 0.85),
    reach AS (SELECT id, id AS r FROM o UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
    least AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
    SELECT c.collection, c.id, component, count(*) OVER (PARTITION BY c.collection, component) AS members
    FROM copies c JOIN o ON o.collection = c.collection AND o.vector = c.vector JOIN least ON least.id = o.id""",
)
def similar_groups(spark, d):
    """Groups of similar vectors by hashing: the components of the links that the exhaustive form has."""
    return L.similar_groups(near_copies(spark, d))


_SEMANTIC = f"""WITH o AS (SELECT collection, vector, min(id) AS id FROM {_COPIES} GROUP BY collection, vector),
    p AS (SELECT b.id, a.id AS hit_id, round(list_cosine_similarity(a.vector::DOUBLE[],
      b.vector::DOUBLE[]), 9) AS score FROM o a JOIN o b ON a.collection = b.collection AND a.id < b.id)
    SELECT id, arg_max(hit_id, (score, -hit_id)) AS hit_id, round(max(score), 6) AS score FROM p
    WHERE score >= 0.95 GROUP BY id
    UNION ALL SELECT c.id, o.id, 1.0 FROM {_COPIES} c JOIN o ON o.collection = c.collection
      AND o.vector = c.vector WHERE c.id <> o.id"""


def dated_vectors(spark, d):
    return near_copies(spark, d).select("tenant_id", "id", F.col("id").alias("at"), "vector")


@query("c03_semantic_cache_hits", _SEMANTIC)
def semantic_hits(spark, d):
    return C.semantic_hits(dated_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("c03_semantic_cache_hashed", _SEMANTIC)
def semantic_hits_hashed(spark, d):
    """The same hits from rows that share a band of hyperplanes."""
    return C.semantic_hits(dated_vectors(spark, d), exhaustive=False).withColumn("score", F.round("score", 6))


# --- cache -----------------------------------------------------------------------------------

def prompts_asked(spark, d):
    """Events as cached prompts: the same few prompts come back with other spelling."""
    i = F.col("event_id")
    prompt = F.concat(F.lit("  Giá  SP-"), F.pmod(i, F.lit(40)).cast("string"),
                      F.when(F.pmod(i, F.lit(2)) == 0, F.lit("\tBAO nhiêu")).otherwise(F.lit(" bao NHIÊU ")))
    return T.events(spark, d).select(
        i.alias("id"), "ts", "model",
        C.exact_key(
            F.col("tenant_id"), prompt, F.when(F.pmod(i, F.lit(7)) != 0, F.col("model")),
            F.when(F.pmod(i, F.lit(7)) != 1, F.pmod(i, F.lit(2)).cast("string")),
        ).alias("cache_key"),
    )


@query(
    "c01_exact_cache_hits",
    with_("ev", then="""SELECT id, cache_key, coalesce(us - lag(us) OVER (PARTITION BY cache_key ORDER BY us, id)
      <= 3600000000, FALSE) AS hit FROM (SELECT event_id AS id, us, sha256('["' || tenant_id || '","giá sp-'
      || event_id % 40 || ' bao nhiêu",' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"' || model || '"' END || ','
      || CASE WHEN event_id % 7 = 1 THEN 'null' ELSE '"' || event_id % 2 || '"' END || ']') AS cache_key FROM ev)"""),
)
def exact_hits(spark, d):
    return C.exact_hits(prompts_asked(spark, d), 3600).select("id", "cache_key", "hit")


@query(
    "c02_cacheable_requests",
    with_("turns", then="""SELECT conv_id, turn FROM turns WHERE turn % 2 = 1 AND conv_id % 4 < 2
    AND turn % 3 <> 0"""),
)
def cacheable(spark, d):
    r = T.requests_pii(spark, d).select(
        "conv_id", "turn", "text", (F.pmod("conv_id", F.lit(4)) * 0.3).alias("temperature"),
        (F.pmod("turn", F.lit(3)) == 0).alias("user_dependent"),
    )
    return C.cacheable(r).select("conv_id", "turn")


# --- agents ----------------------------------------------------------------------------------

STATES = ("PENDING", "PLANNING", "CALLING_TOOL", "PLANNING", "DONE", "WAITING_APPROVAL", "CALLING_TOOL")


def agent_steps(spark, d):
    """Events of a user as the steps of a run."""
    from ..frames import skew

    e = T.events(spark, d).select("event_id", "user_id", "us", "event_type", "cost_micros")
    steps = skew.running(e, ["user_id"], ["us", "event_id"], rank="step", slice=F.floor(F.col("us") / 3_600_000_000))
    return steps.select(
        F.col("user_id").alias("run_id"), "step", "event_id",
        T.pick(STATES, F.col("step") - 1 + F.when(F.pmod("event_id", F.lit(9)) == 0, 1).otherwise(0)).alias("state"),
        F.col("event_type").alias("tool"), F.concat(F.lit("a"), F.pmod("event_id", F.lit(3)).cast("string")).alias("arguments"),
        (F.col("cost_micros").cast("decimal(18,0)") / 100_000).cast("decimal(12,6)").alias("cost_usd"),
    )


_STEPS = f"""(SELECT user_id AS run_id, step, event_id, event_type AS tool, event_id % 3 AS args, cost_micros,
    {choose(STATES, 'step - 1 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END')} AS state FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS step FROM ev))"""
_PAIRS = ", ".join(f"('{a or 'START'}', '{b}')" for a, b in X.TRANSITIONS)


@query(
    "x01_illegal_transitions",
    with_("ev", then=f"""SELECT run_id, step, from_state, to_state FROM (SELECT run_id, step,
      coalesce(lag(state) OVER (PARTITION BY run_id ORDER BY step), 'START') AS from_state,
      state AS to_state FROM {_STEPS} WHERE event_id % 10 <> 3) WHERE (from_state, to_state) NOT IN ({_PAIRS})"""),
)
def illegal_transitions(spark, d):
    """A tenth of the steps was not logged; their numbers are gaps."""
    return X.illegal_transitions(spark, agent_steps(spark, d).where("event_id % 10 <> 3"))


@query(
    "x02_loop_stops",
    with_("ev", then=f"""SELECT run_id, min(step) AS stop_step, arg_min(tool, step) AS tool FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, tool, args ORDER BY step) AS n FROM {_STEPS})
    WHERE n = 3 GROUP BY run_id"""),
)
def loop_stops(spark, d):
    return X.loop_stops(agent_steps(spark, d))


@query(
    "x03_limit_stops",
    with_("ev", then=f"""SELECT run_id, min(step) AS stop_step, arg_min(CASE WHEN spent > 20000
      THEN 'max_cost' ELSE 'max_steps' END, step) AS reason FROM (SELECT *, sum(cost_micros) OVER (
      PARTITION BY run_id ORDER BY step) AS spent FROM {_STEPS}) WHERE step > 12 OR spent > 20000
    GROUP BY run_id"""),
)
def limit_stops(spark, d):
    return X.limit_stops(agent_steps(spark, d))


TOOLS = (("sql_query", "read"), ("search_docs", "read"), ("create_report", "write"), ("send_email", "external"))


@query(
    "x04_approval_status",
    f"""SELECT event_id, CASE WHEN tool = 'shell' THEN 'unregistered' WHEN tool IN ('sql_query', 'search_docs')
      OR (tool = 'create_report' AND event_id % 5 <> 0) THEN 'not_needed'
    WHEN event_id % 7 = 0 THEN 'approved' WHEN 1705320000000000 - us > 86400000000 THEN 'expired'
    ELSE 'waiting' END AS status FROM (SELECT event_id, epoch_us(ts) AS us,
    {choose([*(t[0] for t in TOOLS), 'shell'], 'event_id')} AS tool FROM events)""",
)
def approval_status(spark, d):
    i = F.col("event_id")
    r = T.events(spark, d).select(
        "event_id", T.pick([*(t[0] for t in TOOLS), "shell"], i).alias("tool"), F.col("ts").alias("requested_at"),
        (F.pmod(i, F.lit(5)) == 0).alias("overwrites"),
        F.when(F.pmod(i, F.lit(7)) == 0, "approved").alias("decision"),
    )
    tools = spark.createDataFrame(list(TOOLS), "id string, risk_level string")
    now = F.timestamp_micros(F.lit(1_705_320_000_000_000))
    return X.approval_status(r, tools, now).select("event_id", "status")


@query(
    "x05_production_prompts",
    """SELECT o_custkey % 3 AS tenant_id, 'p' || o_custkey AS name, max(o_orderkey) AS version,
    arg_max(o_orderpriority, o_orderkey) AS template FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""",
)
def production_prompts(spark, d):
    p = T.read(spark, d, "orders").select(
        F.pmod("o_custkey", F.lit(3)).alias("tenant_id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("template"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("production"), F.lit("v")))
        .otherwise(F.array(F.lit("staging"))).alias("labels"),
    )
    return X.labelled_prompts(p)


