"""The SQL of the queries that SQL can express, written apart from the operators, for an engine with the tables as views."""

from __future__ import annotations

from cragline.llm.license_texts import known_texts
from cragline.llm.licenses import EQUIVALENT, EQUIVALENT_PAIRS


def _pour(name: str, parents: list[str], level: str, nodes: str) -> str:
    """CTEs that share the parents' `given` among the nodes(parents, level, weight, cap, given), as {name}(.., budget).

    A node whose cap over its weight is below the level of the pour is full. The level is what the full nodes leave
    of `given` over the weights of the others; nodes are tried in order of cap over weight.
    """
    among = f"PARTITION BY {', '.join(parents)}" if parents else ""
    key = ", ".join([*parents, level])
    return f"""
        {name}_n AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE CAST('inf' AS DOUBLE) END AS fill FROM ({nodes})),
        {name}_s AS (SELECT *, coalesce(sum(cap) OVER ({among} ORDER BY fill, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            sum(weight) OVER ({among} ORDER BY fill, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM {name}_n),
        {name}_l AS (SELECT *, CASE WHEN others > 0 THEN (given - before) / others END AS own_level FROM {name}_s),
        {name}_f AS (SELECT *, fill <= coalesce(own_level, -1) AS is_full FROM {name}_l),
        {name}_x AS (SELECT *, max(CASE WHEN NOT is_full THEN own_level END) OVER ({among}) AS top FROM {name}_f),
        {name} AS (SELECT {key}, tokens, CASE WHEN weight <= 0 THEN 0 WHEN is_full THEN cap ELSE least(cap, greatest(0, weight * coalesce(top, 0))) END AS budget FROM {name}_x)"""


def mixing_sql(weights: dict[str, dict[str, float]], share: float = 0.5, epochs: int = 4, seed: int = 11) -> str:
    """Budgets by pouring from level to level, then whole epochs and a token-prefix of one more."""

    def weight(level: str) -> str:
        arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"CAST(CASE {level} {arms} ELSE 1 END AS DOUBLE)" if arms else "CAST(1 AS DOUBLE)"

    def nodes(key: str, level: str) -> str:
        return f"SELECT {key}, sum(n)::DOUBLE * {float(epochs)} AS cap, CAST(sum(n) AS BIGINT) AS tokens, {weight(level)} AS weight FROM d GROUP BY ALL"

    return f"""
        WITH d AS (
            SELECT doc_id, text, coalesce('d' || (ascii(md5(source)) % 4), '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, lang AS l, source AS s,
                len(regexp_extract_all(text, '[^\\t\\n\\x0b\\f\\r ]+')) AS n, concat_ws('|', doc_id, md5(text)) AS key
            FROM documents WHERE text IS NOT NULL),
        {_pour("top", [], "domain", f"SELECT *, (SELECT CAST(sum(n) AS BIGINT) FROM d) * {share} AS given FROM ({nodes('domain', 'domain')})")},
        {_pour("mid", ["domain"], "lang", f"SELECT a.*, top.budget AS given FROM ({nodes('domain, lang', 'lang')}) a JOIN top USING (domain)")},
        {_pour("low", ["domain", "lang"], "source", f"SELECT a.*, mid.budget AS given FROM ({nodes('domain, lang, source', 'source')}) a JOIN mid USING (domain, lang)")},
        plan AS (SELECT domain, lang, source, tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM low WHERE tokens > 0),
        placed AS (SELECT d.*, budget // tokens AS epochs, budget % tokens AS rest, md5(concat_ws('|', {seed}, budget // tokens, key)) AS place FROM d JOIN plan USING (domain, lang, source) WHERE n > 0),
        sums AS (SELECT *, CAST(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place) AS BIGINT) AS upto, CAST(sum(n) OVER w AS BIGINT) AS here, count(*) OVER w AS rows_here FROM placed WINDOW w AS (PARTITION BY domain, lang, source, place)),
        taken AS (SELECT *, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies, CASE WHEN upto > rest AND upto - here <= rest THEN (rest - (upto - here)) // rows_here ELSE 0 END AS head FROM sums)
        SELECT doc_id, domain AS domain_name, l AS lang, s AS source, CAST(n AS BIGINT) AS tokens, CAST(copies AS BIGINT) AS copies, CAST(copies * n + head AS BIGINT) AS tokens_taken FROM taken WHERE copies * n + head > 0
    """


TOP_K = """
    WITH v AS (
        SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM parts q JOIN parts c USING (i)
        WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL
    ), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

WARC = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
    b AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, 5 * g + 1, 5) AS INT)) AS g FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(g, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM b
"""


def license_sql() -> str:
    """Line by line without the copyright lines, word by word with one spelling, then pairs of words; both sides alike."""
    spelling = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EQUIVALENT.items())

    def form(table: str) -> str:
        pairs = "'  ' || array_to_string(words, '  ') || '  '"
        for a, b in EQUIVALENT_PAIRS.items():
            pairs = f"replace({pairs}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"""SELECT *, sha256(array_to_string(list_filter(string_split({pairs}, ' '), lambda w: w <> ''), ' ')) AS digest FROM (
            SELECT *, list_transform(regexp_extract_all(array_to_string(list_filter(string_split(lower(coalesce(text, '')), chr(10)),
                lambda l: NOT regexp_matches(l, '^[^\\p{{L}}\\p{{N}}]*(copyright[ \t]*(\\(c\\)|©|[0-9]{{4}}|<|\\[|by )|©|\\(c\\)[ \t]*(copyright|[0-9]{{4}}|<|\\[)|all rights reserved)')), chr(10)), '[\\p{{L}}\\p{{N}}]+'),
                lambda w: CASE w {spelling} ELSE w END) AS words FROM {table})"""

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known_texts())
    return f"""
        WITH texts AS (SELECT column0 AS license_id, column1 AS text FROM (VALUES {values}) AS t(column0, column1)),
        known AS (SELECT digest, min(license_id) AS license_id FROM ({form("texts")}) GROUP BY 1),
        forms AS ({form("documents")})
        SELECT doc_id, forms.digest, known.license_id FROM forms LEFT JOIN known USING (digest)
    """
