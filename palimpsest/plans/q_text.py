"""Queries over text functions and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vectors, words
from palimpsest.sources import events as E
from palimpsest.sources import files, web

from . import base
from . import sqltext as Q
from .registry import query

#: Letters of the conversations as Han ones, all but five; a hint behind each turn, by its number.
_LATIN, _WIDE = "abcdfghijklmnpqrsuvwxyz", "数据库连接超时导致订单失败东京会议是来周中文与词"[:23]
_HINTS = ("before 之前 parent", "no hints here", "what happened after the cause", "child task next", "原因 和 上一步", "")
_ID = "conv_id * 1000 + turn"
_HAN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]{2,}"


def _turns(spark, sf):
    t = base.table(spark, sf, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT doc_id, md5({Q.norm("coalesce(text, '')")}) AS digest, length({Q.norm("coalesce(text, '')")}) AS n FROM documents")
def text_normalize(spark, sf):
    n = T.normalize(F.coalesce("text", F.lit("")))
    return base.table(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.char_length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, len(toks)::BIGINT AS n_tokens, toks[1] AS first_token, toks[-1] AS last_token, est AS estimated, rough FROM (SELECT doc_id, {Q.tokens('t')} AS toks, {Q.estimate('t')} AS est, greatest(1, ceil(length(t) / 4))::BIGINT AS rough FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def text_tokens(spark, sf):
    t = F.coalesce("text", F.lit(""))
    x = base.table(spark, sf, "documents").select("doc_id", T.tokens(t).alias("k"), T.estimate_tokens(t).alias("estimated"), T.rough_tokens(t).alias("rough"))
    return x.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.try_element_at("k", F.lit(1)).alias("first_token"), F.try_element_at("k", F.lit(-1)).alias("last_token"), "estimated", "rough")


@query(f"WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {Q.keywords('k', 'src', 'doc_id', 'text', 8)} SELECT doc_id, array_to_string(keywords, ',') AS keywords FROM k")
def text_keywords(spark, sf):
    return base.table(spark, sf, "documents").select("doc_id", F.array_join(T.keywords("text", 8), ",").alias("keywords"))


@query(f"""WITH lit AS (SELECT {_ID} AS id, translate(lower(coalesce(text, '')), '{_LATIN}', '{_WIDE}') || ' 𠀀𠀁' AS a FROM conversations),
r AS (SELECT id, a, list_transform(regexp_extract_all(a, '{_HAN}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) AS runs FROM lit)
SELECT id, array_to_string(flatten(runs), ',') AS grams, {Q.estimate('a')} AS estimated FROM r""")
def text_cjk(spark, sf):
    """The tables have no Han text, so the conversations' letters are turned into it."""
    wide = F.concat(F.translate(F.lower("text"), _LATIN, _WIDE), F.lit(" 𠀀𠀁")).alias("a")
    return _turns(spark, sf).select("id", wide).select("id", F.array_join(T.bigrams("a"), ",").alias("grams"), T.estimate_tokens("a").alias("estimated"))


_HINT = "CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HINTS)) + " END"


@query(f"""WITH src AS (SELECT {_ID} AS id, coalesce(text, '') || ' ' || {_HINT} AS text FROM conversations), n AS (SELECT id, {Q.norm('text')} AS t FROM src)
SELECT id, CASE WHEN NOT {Q.has('t', words.DIRECTIONAL)} THEN NULL WHEN {Q.has('t', words.INCOMING)} THEN 'incoming' WHEN {Q.has('t', words.OUTGOING)} THEN 'outgoing' ELSE 'both' END AS direction,
CASE WHEN NOT {Q.has('t', words.DIRECTIONAL)} THEN NULL ELSE coalesce(nullif(concat_ws(',', CASE WHEN {Q.has('t', words.CAUSE_TYPE)} THEN 'CAUSES' END, CASE WHEN {Q.has('t', words.PARENT_TYPE)} THEN 'PARENT_TASK' END, CASE WHEN {Q.has('t', words.CHILD_TYPE)} THEN 'CHILD_TASK' END), ''), 'FOLLOWS,CONTEXT') END AS types FROM n""")
def text_direction(spark, sf):
    x = _turns(spark, sf).select("id", F.concat_ws(" ", "text", F.expr(_HINT)).alias("text")).select("id", T.directional_intent("text").alias("i"))
    return x.select("id", "i.direction", F.array_join("i.types", ",").alias("types"))


@query("SELECT doc_id, strlen(t) || ':' || sha256(left(t, 2048)) || ':' || sha256(right(t, 2048)) AS near_key, strlen(t) || ':' || sha256(t) AS version_key FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def text_near_dup_key(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return base.table(spark, sf, "documents").select("doc_id", T.near_dup_key(t).alias("near_key"), T.version_key(t).alias("version_key"))


@query("SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) || '-' || left(sha1(url), 8) AS slug FROM pages")
def text_session_slug(spark, sf):
    return base.table(spark, sf, "pages").select("page_id", T.session_slug("url").alias("slug"))


@query(f"WITH t AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS tok FROM conversations) SELECT tok, {Q.token_hash('tok')} AS hash FROM t")
def hash_tokens(spark, sf):
    x = base.table(spark, sf, "conversations").select(F.explode(T.tokens("text")).alias("tok")).distinct()
    return x.select("tok", vectors.token_hash("tok").alias("hash"))


@query(f"WITH {Q.EVENTS}, {Q.vectors('v', 'ev', 'session_id, seq', 'text')} SELECT session_id, seq, bin, round(value, 6) AS value FROM v")
def hash_embedding(spark, sf):
    x = base.events(spark, sf).select("session_id", "seq", F.posexplode(vectors.hash_embedding("text")).alias("bin", "value"))
    return x.filter("value > 0").select("session_id", "seq", F.col("bin").cast("long").alias("bin"), F.round("value", 6).alias("value"))


@query("""WITH u AS (SELECT conv_id, turn, unnest(string_split(t, '')) AS c, unnest(range(0, length(t))) AS i FROM (SELECT conv_id, turn, trim(lower(text), e' \\t\\n\\r') AS t FROM conversations WHERE text <> '')),
b AS (SELECT conv_id, turn, i % 32 AS bin, sum(ord(c))::DOUBLE AS n FROM u WHERE c <> '' GROUP BY ALL) SELECT conv_id, turn, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM b""")
def file_read_vector(spark, sf):
    x = base.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(vectors.file_vector("text")).alias("bin", "value")).filter("value > 0")
    return x.select("conv_id", "turn", F.col("bin").cast("long").alias("bin"), F.round("value", 6).alias("value"))


_SUM = f"""WITH {Q.EVENTS}, j AS (SELECT *, role || ': ' || text AS joined, {Q.squeezed('text')} AS sq FROM ev), {Q.keywords('k', 'j', 'session_id, seq', 'joined', 6)},
s AS (SELECT session_id, seq, text, '[' || role || '] ' || CASE WHEN length(sq) > 120 THEN left(sq, 120) || '…' ELSE sq END || CASE WHEN len(keywords) = 0 THEN '' ELSE e'\\nkeywords: ' || array_to_string(keywords, ', ') END AS summary FROM j JOIN k USING (session_id, seq))"""


@query(f"{_SUM} SELECT session_id, seq, summary, CASE WHEN {Q.has('lower(summary || chr(32) || text)', words.IMPORTANT)} THEN 'important' ELSE 'normal' END AS tag FROM s")
def summary_and_tag(spark, sf):
    e = F.array(F.struct("role", "text"))
    x = base.events(spark, sf).select("session_id", "seq", "text", T.summary(e).alias("summary"))
    return x.select("session_id", "seq", "summary", T.tag(F.concat_ws(" ", "summary", "text")).alias("tag"))


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<noscript.*?</noscript>', ' ', 'gis') AS h FROM pages),
p AS (SELECT page_id, regexp_extract(h, '<title[^>]*>(.*?)</title>', 1, 'is') AS title, CASE WHEN regexp_matches(h, '<body[^>]*>(.*?)</body>', 'is') THEN regexp_extract(h, '<body[^>]*>(.*?)</body>', 1, 'is') ELSE h END AS body FROM h),
c AS (SELECT page_id, """ + ", ".join(Q.squeezed("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x + ", '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '\"', 'gi'), '&#39;', '''', 'gi'), '&#x27;', '''', 'gi')") + " AS " + x for x in ("title", "body")) + """ FROM p)
SELECT page_id, nullif(title, '') AS title, length(left(body, 20000)) AS n_chars, md5(left(body, 20000)) AS digest FROM c""")
def html_to_text(spark, sf):
    x = base.table(spark, sf, "pages").select("page_id", web.html_text("html").alias("t"))
    return x.select("page_id", "t.title", F.char_length("t.content").cast("long").alias("n_chars"), F.md5("t.content").alias("digest"))


@query("""SELECT page_id, url, 'page ' || page_id AS title, 'none' AS source, 1::BIGINT AS rank FROM pages WHERE url <> ''
UNION ALL SELECT page_id, url || '#2', 'second', 'site', 2::BIGINT FROM pages WHERE page_id % 2 = 0""")
def search_payloads(spark, sf):
    """Pages wrapped in the payload shapes of search services and taken out again."""
    p = base.table(spark, sf, "pages")
    one = F.struct(F.col("url").alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("snippet"))
    two = F.struct(F.concat("url", F.lit("#2")).alias("link"), F.lit(" second ").alias("name"), F.lit("site").alias("siteName"))
    odd = F.struct(F.lit("").alias("url"), F.lit("without address").alias("title"))
    wrap = F.concat(F.lit('{"data":{"webPages":{"value":['), F.to_json(one), F.lit(","), F.to_json(two), F.lit(","), F.to_json(odd), F.lit("]}}}"))
    payload = F.when(F.col("page_id") % 2 == 0, wrap).otherwise(F.concat(F.lit('{"items":['), F.to_json(one), F.lit("]}")))
    return web.search_results(p.withColumn("payload", payload), ["page_id"], "payload", provider="none").select("page_id", "url", "title", "source", "rank")


@query("""WITH x AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn % 5 <> 4 AND text <> '')
SELECT conv_id AS source, turn AS ordinal, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE 'user' END AS role, md5(trim(text, e' \\t\\n\\r')) AS digest, 1700000000000 + turn * 1000 AS ts_ms, '{"turn":' || turn || '}' AS metadata FROM x""")
def ingest_jsonl(spark, sf):
    """Conversations as JSON lines, every fifth malformed, read back as events."""
    c = base.table(spark, sf, "conversations").filter("text <> ''")
    line = F.to_json(F.struct(F.upper("role").alias("role"), F.col("text").alias("content"), (F.lit(1_700_000_000) + F.col("turn")).alias("timestamp"), F.col("turn").alias("turn")))
    x = c.withColumn("line", F.when(F.col("turn") % 5 == 4, F.lit('{"role": "user", "content": ')).otherwise(line))
    rows = E.jsonl_rows(x.withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "key", "turn", "line")
    events, _ = E.normalized(rows, text_field="content")
    return events.select(F.substring_index("source", "/", 1).cast("long").alias("source"), "ordinal", "role", F.md5("text").alias("digest"), "ts_ms", "metadata")


@query("""WITH p AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n(?:\\s*\\r?\\n)+')) AS raw FROM documents), t AS (SELECT doc_id, trim(raw, e' \\t\\n\\r') AS text FROM p)
SELECT doc_id, count(*) FILTER (text <> '') AS records, count(*) FILTER (text = '') AS skipped, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM t GROUP BY doc_id""")
def ingest_paragraphs(spark, sf):
    events, rejects = E.text_items(base.table(spark, sf, "documents"), "doc_id", "text")
    n = E.ingest_summary(events, rejects)
    chars = events.groupBy("source").agg(F.sum(F.char_length("text")).alias("n_chars"))
    return n.join(chars, "source", "left").select(F.col("source").cast("long").alias("doc_id"), "records", "skipped", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def metadata_residue(spark, sf):
    """All JSON properties of the event stream, as the ingest's metadata keeps them."""
    x = base.table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    m = F.try_variant_get("v", "$", "map<string,variant>")
    return x.select("event_id", F.explode(m).alias("key", "_v")).select("event_id", "key", F.try_variant_get("_v", "$", "string").alias("value"))


#: What stands before a turn's text: calls in the three shapes that are known, by the turn's number.
_CALLS = ("so <tool_call>{\"name\":\"search\",\"args\":{\"q\":\"@\"}}</tool_call> ", "```json\n{\"tool\":\"read\"}\n``` ", "{\"function\":{\"name\":\"list\",\"arguments\":{\"path\":\"@\"}}}", "")


@query(f"""SELECT {_ID} AS id, CASE turn % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'read' WHEN 2 THEN 'list' END AS name,
CASE turn % 4 WHEN 0 THEN '{{"q":"' || role || '"}}' WHEN 1 THEN '{{}}' WHEN 2 THEN '{{"path":"' || role || '"}}' END AS args FROM conversations""")
def tool_calls(spark, sf):
    """A call before each turn's text; a bare one stands for the whole turn, and each fourth turn has none."""
    call = F.element_at(F.array(*map(F.lit, _CALLS)), (F.col("turn") % 4 + 1).cast("int"))
    text = F.concat(F.replace(call, F.lit("@"), F.col("role")), F.when(F.col("turn") % 4 == 2, "").otherwise(F.col("text")))
    return _turns(spark, sf).select("id", T.tool_call(text).alias("t")).select("id", "t.name", "t.args")


@query("SELECT doc_id, strlen(t) AS size, least(strlen(t), 4096) AS bytes_read, strlen(t) > 4096 AS truncated, 'snapshot:doc/' || doc_id || '#' || strlen(t) || ':' || sha256(t) AS snapshot_id FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def file_snapshots(spark, sf):
    t = F.coalesce("text", F.lit(""))
    d = base.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(t).cast("long").alias("size"), F.least(F.octet_length(t), F.lit(4096)).cast("long").alias("bytes_read"), (F.octet_length(t) > 4096).alias("truncated"), F.lit(0).cast("long").alias("modified_ms"), t.alias("text"))
    all_ = files.access_tables(d)
    ids = all_["snapshots"].select("snapshot_id", "path", "size").join(all_["accesses"].select("snapshot_id", "bytes_read", "truncated"), "snapshot_id")
    return ids.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "size", "bytes_read", "truncated", "snapshot_id").distinct()


_GAPS = "SELECT o_orderkey AS id, (o_orderkey * 7919) % 400000000 AS gap, o_orderkey % 9 AS k FROM orders"


def _ladder(steps, rest):
    return "CASE " + " ".join(f"WHEN gap <= {n} THEN {v}" for n, v in steps) + f" ELSE {rest} END"


_H, _M = 3_600_000, 60_000


@query(f"SELECT id, {_ladder([(_H, 1.0), (6 * _H, 0.6), (24 * _H, 0.3)], 0.0)}::DOUBLE AS history, {_ladder([(5 * _M, 1.0), (30 * _M, 0.8), (2 * _H, 0.55), (24 * _H, 0.3)], 0.1)}::DOUBLE AS relation, {_ladder([(_H, 1.0), (6 * _H, 0.75), (24 * _H, 0.45), (72 * _H, 0.2)], 0.08)}::DOUBLE AS neighbor FROM ({_GAPS})")
def recency_ladders(spark, sf):
    o = base.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), ((F.col("o_orderkey").cast("long") * 7919) % 400_000_000).alias("gap"))
    z = F.lit(0).cast("long")
    return o.select("id", S.recency_history(F.col("gap"), z).alias("history"), S.recency_relation(F.col("gap"), z).alias("relation"), S.recency_neighbor(z, F.col("gap")).alias("neighbor"))
