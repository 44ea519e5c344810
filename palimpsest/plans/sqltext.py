"""Pieces of DuckDB SQL that the queries' SQL counterparts are put together from."""

from __future__ import annotations

from palimpsest.functions import words

_WS = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_WIDE = r"[\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}\x{20000}-\x{2a6df}]"

EVENTS = "ev AS (SELECT conv_id AS session_id, turn AS seq, role, coalesce(text, '') AS text, 1704067200000 + conv_id * 86400000 + turn * 60000 AS ts_ms FROM conversations)"
STOP = ", ".join(f"'{w}'" for w in (*words.STOP_EN, *words.STOP_ZH))


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


def norm(x: str) -> str:
    return squeezed(f"lower({x})")


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({norm(x)}, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


def estimate(x: str) -> str:
    wide = f"(length({x}) - length(regexp_replace({x}, '{_WIDE}', '', 'g')))"
    units = f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    return f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, ceil(1.5 * {wide} + ({units} - {wide}) / 4))::BIGINT END"


def has(x: str, hints) -> str:
    return "(" + " OR ".join(f"contains({x}, '{h}')" for h in hints) + ")"


def keywords(name: str, source: str, ids: str, text: str, n: int) -> str:
    """A CTE name(ids, keywords), and the CTEs it needs; every row of the source has one."""
    keys = ids.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""{name}_t AS (SELECT {ids}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM (SELECT {ids}, {tokens(text)} AS toks FROM {source})),
{name}_c AS (SELECT {ids}, tok, count(*) AS c, min(p) AS p, row_number() OVER (PARTITION BY {ids} ORDER BY count(*) DESC, min(p)) AS r FROM {name}_t WHERE length(tok) > 1 AND tok NOT IN ({STOP}) GROUP BY {ids}, tok),
{name}_l AS (SELECT {ids}, list(tok ORDER BY r) AS keywords FROM {name}_c WHERE r <= {n} GROUP BY {ids}),
{name} AS (SELECT {", ".join("a." + k for k in keys)}, coalesce(b.keywords, []::VARCHAR[]) AS keywords FROM {source} a LEFT JOIN {name}_l b ON {on})"""


def token_hash(t: str) -> str:
    h = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({t}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"
    return f"(SELECT CASE WHEN x >= 2147483648 THEN 4294967296 - x ELSE x END FROM (SELECT {h} AS x))"


def vectors(name: str, source: str, ids: str, text: str, dim: int = 256) -> str:
    """A CTE name(ids, bin, value) of sparse hash embeddings at unit length."""
    return f"""{name}_t AS (SELECT {ids}, unnest({tokens(text)}) AS tok FROM {source}),
{name}_h AS (SELECT tok, {token_hash("tok")} % {dim} AS bin FROM (SELECT DISTINCT tok FROM {name}_t)),
{name}_b AS (SELECT {ids}, bin, count(*)::DOUBLE AS n FROM {name}_t JOIN {name}_h USING (tok) GROUP BY {ids}, bin),
{name} AS (SELECT {ids}, bin, n / sqrt(sum(n * n) OVER (PARTITION BY {ids})) AS value FROM {name}_b)"""
