"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

import string

SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex({{}}, '{SPACE}'), lambda x: x <> '')"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * COUNT(*) >= 80 * (MAX(a.n) + MAX(b.n) - COUNT(*))),
r AS (SELECT doc_id AS id, doc_id AS root FROM g UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, m.root AS component_id FROM g JOIN (SELECT id, MIN(root) AS root FROM r GROUP BY id) m ON g.doc_id = m.id"""


def _spans(kind: str, rank: int, pattern: str, group: int, keep: str, last: bool = False) -> str:
    """Rows (doc_id, kind, rank, start, end) of the matches whose group ``v`` passes ``keep``; ``last``: the span is the group, at the match's end."""
    p = pattern.replace("'", "''")
    begin, size = (" + length(found[i]) - length(vals[i])", "length(vals[i])") if last else ("", "length(found[i])")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0){begin} AS s, {size} AS size, vals[i] AS v
 FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {group}) AS vals FROM d WHERE regexp_matches(t, '{p}')) x) y WHERE {keep.format(v='vals[i]')}"""


def _digest(base: tuple[str, ...], kinds: list[str], order: str) -> str:
    counts = ", ".join(f"COUNT(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in base)
    names = ", ".join(f"'{k}'" for k in base)
    label = "kind || ':' || s || ':' || (s + size)"
    return f"""m AS ({' UNION ALL '.join(kinds)}), a AS (SELECT doc_id, {counts}, string_agg(CASE WHEN kind IN ({names}) THEN {label} END, ',' ORDER BY {order}) AS base, string_agg({label}, ',' ORDER BY {order}) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'CAST(COALESCE(n_{k}, 0) AS BIGINT) AS n_{k}' for k in base)}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _op5() -> str:
    from panelforge.llm.secrets import BASE, RULES

    # the contract's patterns, written out: group and least length
    plain = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20),
        "hex": (r"[0-9a-f]+", 0, 24),
        # a token after a character that no token has, which this engine can only match with it
        "jwt": (r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)", 2, 0),
    }
    rules = [(r.kind, *plain.get(r.kind, (r.pattern, r.group, r.least))) for r in RULES]
    kinds = [_spans(kind, i, pattern, group, f"length({{v}}) >= {least}", kind == "jwt") for i, (kind, pattern, group, least) in enumerate(rules)]
    return "WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), " + _digest(tuple(r.kind for r in BASE), kinds, "s, rank")


def _op6() -> str:
    from panelforge.llm.personal_data import ADDED, BASE, CONTEXT, KINDS

    digits = "regexp_replace({v}, '[^0-9]', '', 'g')"
    at = f"CAST(substr({digits}, length({digits}) - j, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda j: CASE WHEN j % 2 = 0 THEN {at} ELSE ({at} * 2) % 10 + {at} // 5 END)) % 10 = 0"
    moved = "array_to_string(list_transform(string_split(substr({v}, 5) || substr({v}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split({v}, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CAST(c AS INT)), lambda a, x: (a * 10 + x) % 97) % 97 = 1",
    }
    # the contract's plain patterns; the operator's are their possessive and anchored forms
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rows = [_spans(k.name, i, plain.get(k.name, k.pattern), 0, checks[k.name]) for i, k in enumerate(KINDS)]
    query = "WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), " + _digest(tuple(k.name for k in BASE), rows, "rank, s")
    score = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {k.score} + CASE WHEN regexp_matches(lower(substr(d.t, CAST(greatest(s - {CONTEXT} + 1, 1) AS BIGINT), CAST(least(s, {CONTEXT}) AS BIGINT))), '{k.words}') THEN {ADDED} ELSE 0 END" for k in KINDS) + " END"
    scores = f"sc AS (SELECT m.doc_id, string_agg(CAST({score} AS VARCHAR), ',' ORDER BY rank, s) AS scores FROM m JOIN d ON m.doc_id = d.doc_id GROUP BY m.doc_id)"
    head, tail = query.rsplit("\nSELECT d.doc_id", 1)
    return f"{head}, {scores}\nSELECT d.doc_id{tail} LEFT JOIN sc ON d.doc_id = sc.doc_id".replace("AS spans FROM d LEFT", "AS spans, COALESCE(scores, '') AS scores FROM d LEFT")


OP13 = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > MIN(t.doc_id) OVER (PARTITION BY text), FALSE) AS e
 FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order FROM f f1 JOIN f f2 ON f2.f <> f1.f JOIN f f3 ON f3.f NOT IN (f1.f, f2.f) JOIN f f4 ON f4.f NOT IN (f1.f, f2.f, f3.f) JOIN f f5 ON f5.f NOT IN (f1.f, f2.f, f3.f, f4.f)),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS f, filter_order[1:i - 1] AS done FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS i) x),
r AS (SELECT part, filter_order, step, f, SUM(CASE WHEN translate(fails, done || f, '') = fails THEN n ELSE 0 END) AS kept,
 SUM(CASE WHEN contains(fails, f) AND translate(fails, done, '') = fails THEN n ELSE 0 END) AS removed, SUM(CASE WHEN contains(fails, f) AND translate(fails, done, '') <> fails THEN n ELSE 0 END) AS redundant, SUM(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
 SUM(CASE WHEN contains(fails, f) AND translate(fails, done, '') = fails THEN good ELSE 0 END) AS good_lost, SUM(CASE WHEN contains(fails, f) AND translate(fails, done, '') = fails THEN toxic ELSE 0 END) AS toxic_lost FROM c CROSS JOIN s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

#: SHA-1 in hex to base 32: five hex digits are four characters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) // {32**k}) % 32 AS INT) + 1, 1)" for i in range(8) for k in (3, 2, 1, 0))
OP3 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, MAX(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to FROM m"""


def _op4() -> str:
    """Slots by hash; the owner of each slot is the table that ``fill`` makes, which a test compares with turns taken one by one."""
    from panelforge.llm.sharding import SHARDS, SLOTS, fill

    owners = ",".join(map(str, fill(SHARDS)))
    names = ", ".join(f"'{x}'" for x in SHARDS)
    return f"""WITH t AS (SELECT [{owners}] AS owner, [{names}] AS shards), s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INT) AS shard_slot FROM documents)
SELECT doc_id, shard_slot, shards[owner[shard_slot + 1] + 1] AS shard FROM s CROSS JOIN t"""


ORACLES = {"op3_warc": OP3, "op4_sharding": _op4(), "op13_filter_audit": OP13, "op1_ngram_jaccard_join": OP1, "op5_secret_scan": _op5(), "op6_personal_data": _op6()}
