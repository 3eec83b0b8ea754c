"""SQL that finds and ranks what a search-box query finds, for the twins of the search queries."""

from __future__ import annotations

from gleanery.functions import porter
from gleanery.operators import fulltext


def _form(x: str) -> str:
    """A letter v or c for each letter of ``x``."""
    return f"list_reduce(list_prepend('', string_split({x}, '')), lambda a, b: a || CASE WHEN b IN ('a', 'e', 'i', 'o', 'u') OR (b = 'y' AND a LIKE '%c') THEN 'v' ELSE 'c' END)"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_form(x)}, 'v+c+'))"


def _short(x: str) -> str:
    return f"({_form(x)} LIKE '%cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _swaps(pairs) -> str:
    cases = [f"WHEN s LIKE '%{a}' THEN CASE WHEN {_measure(f'left(s, -{len(a)})')} > 0 THEN left(s, -{len(a)}) || '{b}' ELSE s END" for a, b in sorted(pairs, key=lambda p: -len(p[0]))]
    return f"CASE {' '.join(cases)} ELSE s END"


def stems(words: str) -> str:
    """CTEs that end in ``stems`` (w, s) for the column w of the relation ``words``."""
    cut4 = [f"WHEN s LIKE '%{x}' THEN CASE WHEN {_measure(f'left(s, -{len(x)})')} > 1" + (f" AND regexp_matches(left(s, -{len(x)}), '[st]$')" if x == "ion" else "") + f" THEN left(s, -{len(x)}) ELSE s END" for x in sorted(porter.STEP4, key=len, reverse=True)]
    has_vowel = lambda x: f"{_form(x)} LIKE '%v%'"
    steps = {
        "a1": "CASE WHEN regexp_matches(s, '(sses|ies)$') THEN left(s, -2) WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, -1) ELSE s END",
        "b1": f"CASE WHEN s LIKE '%eed' THEN CASE WHEN {_measure('left(s, -3)')} > 0 THEN left(s, -1) ELSE s END WHEN s LIKE '%ed' THEN CASE WHEN {has_vowel('left(s, -2)')} THEN left(s, -2) || '+' ELSE s END WHEN s LIKE '%ing' AND {has_vowel('left(s, -3)')} THEN left(s, -3) || '+' ELSE s END",
        "b2": f"CASE WHEN s NOT LIKE '%+' THEN s WHEN regexp_matches(s, '(at|bl|iz)[+]$') OR ({_measure('left(s, -1)')} = 1 AND {_short('left(s, -1)')}) THEN left(s, -1) || 'e' WHEN length(s) > 2 AND s[-2] = s[-3] AND {_form('left(s, -1)')} LIKE '%c' AND s[-2] NOT IN ('l', 's', 'z') THEN left(s, -2) ELSE left(s, -1) END",
        "c1": f"CASE WHEN s LIKE '%y' AND {has_vowel('left(s, -1)')} THEN left(s, -1) || 'i' ELSE s END",
        "d2": _swaps(porter.STEP2),
        "d3": _swaps(porter.STEP3),
        "d4": f"CASE {' '.join(cut4)} ELSE s END",
        "e1": f"CASE WHEN s LIKE '%e' AND ({_measure('left(s, -1)')} > 1 OR ({_measure('left(s, -1)')} = 1 AND NOT {_short('left(s, -1)')})) THEN left(s, -1) ELSE s END",
        "e2": f"CASE WHEN s LIKE '%ll' AND {_measure('s')} > 1 THEN left(s, -1) ELSE s END",
    }
    parts, last = [f"plain AS (SELECT w, w AS s FROM {words} WHERE regexp_full_match(w, '[a-z]{{3,}}'))"], "plain"
    for name, expression in steps.items():
        parts.append(f"{name} AS MATERIALIZED (SELECT w, {expression} AS s FROM {last})")
        last = name
    return ", ".join(parts) + f", stems AS MATERIALIZED (SELECT * FROM {last} UNION ALL SELECT w, w FROM {words} WHERE NOT regexp_full_match(w, '[a-z]{{3,}}'))"


def search(query: str, fields: dict[str, str], table: str = "documents", key: str = "doc_id", where: str = "true") -> str:
    """CTEs that end in ``found`` (key, score) for a query that wants something, over rows for which ``where`` holds."""
    q = fulltext.asked(query)
    names = {p: f"p{i}" for i, p in enumerate(q.phrases)}
    inverse = "CASE f " + " ".join(f"WHEN {i} THEN {1 / fulltext.WEIGHTS[x]}" for i, x in enumerate(fields.values())) + " END"
    lists = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '{fulltext.WORD}') AS w{i}" for i, f in enumerate(fields))
    before = lambda i: " + ".join(["1", *[f"len(w{j}) + 1" for j in range(i)]])
    places = " UNION ALL ".join(f"SELECT key, unnest(w{i}) AS w, unnest(range({before(i)}, {before(i)} + len(w{i}))) AS pos, {i} AS f FROM listed" for i in range(len(fields)))
    stop, terms = (", ".join(f"'{x}'" for x in sorted(words)) for words in (porter.STOP, q.terms))
    parts = [
        f"listed AS (SELECT {key} AS key, {lists} FROM {table} WHERE {where})",
        f"places AS MATERIALIZED ({places})",
        f"vocabulary AS (SELECT DISTINCT w FROM places WHERE w NOT IN ({stop}))",
        stems("vocabulary"),
        f"hits AS MATERIALIZED (SELECT key, pos, {inverse} AS inverse, s AS term FROM places JOIN stems USING (w) WHERE s IN ({terms}))",
    ]
    for phrase, name in names.items():
        joins = "".join(f" JOIN hits h{i} ON h{i}.key = h.key AND h{i}.pos = h.pos + {o} AND h{i}.term = '{t}'" for i, (o, t) in enumerate(phrase[1:]))
        parts.append(f"{name} AS (SELECT h.key, h.pos, h.inverse FROM hits h{joins} WHERE h.term = '{phrase[0][1]}')")
    groups = range(len(q.wanted))
    parts.append("entries AS (" + " UNION ALL ".join(f"SELECT key, pos, {g} AS g, inverse::DOUBLE AS inverse FROM {names[p]}" for g in groups for p in dict.fromkeys(q.wanted[g])) + ")")
    banned = "".join(f" AND key NOT IN (SELECT key FROM {names[p]})" for p in q.banned)
    parts += [
        f"whole AS (SELECT key FROM entries GROUP BY key HAVING count(DISTINCT g) = {len(q.wanted)}{banned})",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, g, inverse) AS nth FROM entries WHERE key IN (SELECT key FROM whole))",
        "lasts AS MATERIALIZED (SELECT *, sum(inverse) OVER (PARTITION BY key ORDER BY nth) AS upto, " + ", ".join(f"max(CASE WHEN g = {g} THEN nth END) OVER (PARTITION BY key ORDER BY nth) AS l{g}" for g in groups) + " FROM numbered)",
        "covers AS (SELECT key, least(" + ", ".join(f"l{g}" for g in groups) + ") AS first, min(nth) AS last FROM lasts WHERE " + " AND ".join(f"l{g} IS NOT NULL" for g in groups) + " GROUP BY ALL)",
        "measured AS (SELECT key, last - first + 1 AS n, b.upto - a.upto + a.inverse AS inverses, b.pos - a.pos - (last - first) AS noise FROM covers JOIN lasts a USING (key) JOIN lasts b USING (key) WHERE a.nth = first AND b.nth = last)",
        f"found AS MATERIALIZED (SELECT key AS {key}, round(sum(n / inverses / (1 + CASE WHEN noise < 0 THEN (n - 1) // 2 ELSE noise END)), 6) AS score FROM measured GROUP BY key)",
    ]
    return ", ".join(parts)
