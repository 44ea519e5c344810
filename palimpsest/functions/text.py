"""Text functions as columns: normalising, tokens, keywords, summaries, hints, keys.

All are built-in expressions but for keywords(), whose count by first appearance is linear in the text only
in an Arrow UDF.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.shipping import ship_active

from . import words

#: White space as the Unicode-aware "\s" of the event format has it, wider than Java's.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NOT_TOKEN = r"[^\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+"
#: The same in texts that are all ASCII.
PLAIN_TOKEN = re.compile(r"\w+", re.ASCII)
#: And in texts without a character beyond U+024F, on which Java, Python and SQL agree; a text with one is FAR.
NEAR_TOKEN, FAR = re.compile(r"\w+"), r"[^\x{0000}-\x{024F}]"
#: Rows of a batch that are Python objects at a time.
ROWS = 256
#: Characters that count one and a half tokens, and those that form two-character keys.
WIDE = r"[\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}\x{20000}-\x{2a6df}]"
HAN = r"([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]{2,})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), SPACE + "+", " "))


def normalize(text: Column | str) -> Column:
    return squeezed(F.lower(_c(text)))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(_c(text)), NOT_TOKEN), lambda t: t != "")


def spaced_tokens(text: Column | str) -> Column:
    """The same tokens in one string, with a space between them (and maybe at the ends)."""
    return F.regexp_replace(F.lower(_c(text)), NOT_TOKEN, " ")


def units(text: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column | str) -> Column:
    """0 for an empty text, else ceil(1.5 * wide characters + other units / 4), 1 at least."""
    text = F.coalesce(_c(text), F.lit(""))
    wide = F.char_length(text) - F.char_length(F.regexp_replace(text, WIDE, ""))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.ceil(1.5 * wide + (units(text) - wide) / 4)))


def rough_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.char_length(F.coalesce(_c(text), F.lit(""))) / 4))


def far_tokens(text: Column | str) -> Column:
    """spaced_tokens of texts that are FAR, null for others, which Python cuts by near_counts."""
    plain = F.octet_length(_c(text)) == F.char_length(_c(text))
    return F.when(~plain & F.rlike(_c(text), F.lit(FAR)), spaced_tokens(text))


def near_counts(text: str) -> Counter:
    """Tokens of a text that is not FAR, or of spaced tokens, and their numbers, by first appearance."""
    low = text.lower()
    return Counter((PLAIN_TOKEN if low.isascii() else NEAR_TOKEN).findall(low))


def keyword_list(text: str | None, n: int) -> list[str]:
    """The n most frequent tokens but stop words and single units, by count, then first appearance."""
    low = (text or "").lower()
    if low.isascii():
        return most_frequent(Counter(PLAIN_TOKEN.findall(low)), n)
    import regex

    return most_frequent(Counter(regex.findall(TOKEN, low)), n)


def most_frequent(counts: Counter, n: int) -> list[str]:
    """The n keywords of counted tokens; tokens that occur once are looked at only where the others don't suffice."""
    fit = lambda t: t not in words.STOP and (len(t) > 1 or ord(t[0]) > 0xFFFF)
    found = [(t, c) for t, c in counts.items() if c > 1 and fit(t)]
    if len(found) < n:
        found = [(t, c) for t, c in counts.items() if fit(t)]
    return [t for t, _ in sorted(found, key=lambda x: -x[1])[:n]]  # in the order of the text where counts are equal


def keywords(text: Column | str, n: int = 8) -> Column:
    ship_active()

    @F.arrow_udf("array<string>")
    def run(s: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([keyword_list(t, n) for t in s.slice(at, ROWS).to_pylist()], kind) for at in range(0, len(s), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run(_c(text))


def contains_any(text: Column, hints: Sequence[str]) -> Column:
    """Whether a hint is a substring (not a word) of the text."""
    found = F.lit(False)
    for h in hints:
        found = found | F.contains(text, F.lit(h))
    return found


def bigrams(keyword: Column | str) -> Column:
    """All two-character pieces of each run of Han characters."""
    runs = F.regexp_extract_all(_c(keyword), F.lit(HAN), F.lit(1))
    pieces = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(pieces)


def index_keys(keys: Column | str) -> Column:
    """Normalised keywords followed by their two-character pieces, each once, in order."""
    own = F.filter(F.transform(_c(keys), normalize), lambda k: k != "")
    return F.array_distinct(F.flatten(F.transform(own, lambda k: F.concat(F.array(k), bigrams(k)))))


def has_direction(text: Column | str) -> Column:
    return contains_any(normalize(text), words.DIRECTIONAL)


def directional_intent(text: Column | str, depth: int = 1) -> Column:
    """struct(direction, types, depth), null without a directional hint."""
    n = normalize(text)
    direction = F.when(contains_any(n, words.INCOMING), "incoming").when(contains_any(n, words.OUTGOING), "outgoing").otherwise("both")
    one = lambda hints, name: F.when(contains_any(n, hints), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    types = F.concat(one(words.CAUSE_TYPE, "CAUSES"), one(words.PARENT_TYPE, "PARENT_TASK"), one(words.CHILD_TYPE, "CHILD_TASK"))
    types = F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("FOLLOWS"), F.lit("CONTEXT")))
    return F.when(has_direction(text), F.struct(direction.alias("direction"), types.alias("types"), F.lit(depth).alias("depth")))


def clipped(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def users_first(events: Column | str, n: int) -> Column:
    """The first n events, those of users before others, each group in order."""
    e = _c(events)
    return F.slice(F.concat(F.filter(e, lambda x: x["role"] == "user"), F.filter(e, lambda x: x["role"] != "user")), 1, n)


def preview(events: Column | str) -> Column:
    """Up to three lines "[role] text", texts squeezed and cut at 120 characters."""
    lines = F.transform(users_first(events, 3), lambda e: F.concat(F.lit("["), e["role"], F.lit("] "), clipped(squeezed(e["text"]), 120)))
    return F.array_join(lines, "\n")


def joined_events(events: Column | str) -> Column:
    return F.array_join(F.transform(_c(events), lambda e: F.concat(e["role"], F.lit(": "), e["text"])), " ")


def summary(events: Column | str) -> Column:
    """The preview, and a line with the six main keywords of all events; empty without events."""
    top = keywords(joined_events(events), 6)
    return F.when(F.size(_c(events)) == 0, "").otherwise(F.when(F.size(top) == 0, preview(events)).otherwise(F.concat(preview(events), F.lit("\nkeywords: "), F.array_join(top, ", "))))


def importance(text: Column, conflict: Column | None = None, mode: Column | None = None, match: Column | None = None) -> Column:
    """0 to 1 from hints in summary and events; text is both, joined."""
    merged = F.trim(F.lower(text))
    score = F.when(contains_any(merged, words.IMPORTANT), 0.8).otherwise(0.0)
    score = score + F.when(F.coalesce(mode, F.lit("raw")) == "conflict" if mode is not None else F.lit(False), 0.2).otherwise(0.0)
    score = score + F.when((match if match is not None else F.lit(0.0)) < 0.15, 0.05).otherwise(0.0)
    score = F.when(merged == "", 0.0).otherwise(F.least(F.lit(1.0), score))
    return F.when(conflict, 0.95).otherwise(score) if conflict is not None else score


def tag(text: Column, threshold: float = 0.6, allowed: Sequence[str] = ("important", "normal"), **more) -> Column:
    """One tag: important from the threshold on, else normal, else the first that is allowed."""
    rest = "normal" if "normal" in allowed or not allowed else allowed[0]
    return F.when(importance(text, **more) >= threshold, "important").otherwise(rest) if "important" in allowed else F.lit(rest)


def normalize_tags(tags: Column | str, allowed: Sequence[str] = ("important", "normal")) -> Column:
    """Trimmed, lower-cased, allowed ones, each once; normal, or the first allowed, if none is left."""
    own = F.array_distinct(F.filter(F.transform(_c(tags), lambda t: F.lower(F.trim(t))), lambda t: t.isin(list(allowed))))
    fallback = "normal" if "normal" in allowed or not allowed else allowed[0]
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(F.array(F.lit(fallback)))


def near_dup_key(text: Column | str) -> Column:
    """Size, hash of the first and of the last 2048 characters."""
    t = _c(text)
    return F.concat_ws(":", F.octet_length(t).cast("string"), F.sha2(F.left(t, F.lit(2048)), 256), F.sha2(F.right(t, F.lit(2048)), 256))


def version_key(text: Column | str) -> Column:
    return F.concat_ws(":", F.octet_length(_c(text)).cast("string"), F.sha2(_c(text), 256))


def session_slug(name: Column | str) -> Column:
    """Lower-case name of letters, digits, dot, underscore and dash, 48 at most, and eight digits of its SHA-1."""
    n = _c(name)
    slug = F.regexp_replace(F.regexp_replace(F.lower(n), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.left(slug, F.lit(48)), F.lit("-"), F.left(F.sha1(n), F.lit(8)))


def fixed3(x: Column) -> Column:
    return F.format_string("%.3f", x)


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the prefix that both share."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(F.left(a, i) == F.left(b, i), i).otherwise(0))
    return F.array_max(same)


def tool_call(text: Column | str) -> Column:
    """struct(name, args) of the first tool call in a text: a tag, a fenced block or a bare object; null without one."""
    t = _c(text)
    none = lambda x: F.when(x == "", F.lit(None)).otherwise(x)
    body = F.coalesce(
        none(F.regexp_extract(t, r"(?is)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)), none(F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)),
        none(F.regexp_extract(F.trim(t), r"(?s)^(\{.*\})$", 1)),
    )
    get = lambda *paths: F.coalesce(*[F.get_json_object(body, f"$.{p}") for p in paths])
    direct = get("name", "tool")
    name = F.coalesce(direct, get("function.name"))
    args = F.when(direct.isNotNull(), get("args", "arguments")).otherwise(get("function.arguments", "function.args"))
    args = F.when(args.rlike(r"^\s*\{"), args).otherwise("{}")
    return F.when(name.isNotNull(), F.struct(name.alias("name"), args.alias("args")))


def render(template: Column, values: Column, limit: int = 12_000) -> Column:
    """{{name}} from a map of strings; unknown names are empty; \\{{ stays as {{; longer results are cut and say so."""
    mark = F.lit("\u0001")
    parts = F.split(F.replace(template, F.lit("\\{{"), mark), r"\{\{(?=\s*[A-Za-z_][A-Za-z0-9_]*\s*\}\})")
    fill = lambda p: F.concat(F.coalesce(F.element_at(values, F.trim(F.substring_index(p, "}}", 1))), F.lit("")), F.substr(p, F.instr(p, "}}") + 2))
    done = F.replace(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(fill(p))), ""), mark, F.lit("{{"))
    return F.when(F.char_length(done) <= limit, done).otherwise(F.concat(F.left(done, F.lit(limit)), F.lit("\n...[truncated]")))
