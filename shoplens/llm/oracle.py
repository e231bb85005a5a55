"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from shoplens.llm.divergence import LEAST_DOCS, TOP_TERMS
from shoplens.llm.jaccard_join import PERCENT
from shoplens.llm.mixing import MAX_EPOCHS, RANGES, SHARE, WEIGHTS
from shoplens.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS
from shoplens.llm.warc import LEAST

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_features(docs: str = "documents") -> str:
    """SQL of the measures, over a relation with ``text``; keeps all its columns."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
    q0 AS (SELECT row_number() OVER () AS _row, *, {_WORDS} AS _w, coalesce(text, '') AS _t FROM {docs}),
    q1 AS (SELECT *, list_filter(string_split(_t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS _l FROM q0),
    gram AS (SELECT _row, i, _w[i:i + 4] AS g FROM (SELECT _row, _w, unnest(range(1, len(_w) - 3)) AS i FROM q0 WHERE len(_w) >= 5)),
    rep AS (SELECT _row, i FROM (SELECT _row, i, count(*) OVER (PARTITION BY _row, g) AS c FROM gram) WHERE c > 1),
    cov AS (SELECT _row, count(DISTINCT j) AS n_repeat_words FROM (SELECT _row, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY _row),
    feat AS (SELECT q1.*, len(_w)::BIGINT AS n_words,
        length(array_to_string(_w, ''))::BIGINT AS word_chars,
        length(regexp_replace(_t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(_t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
        len(_l)::BIGINT AS n_lines,
        (len(_l) - len(list_distinct(_l)))::BIGINT AS n_dup_lines,
        coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(_w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
      FROM q1 LEFT JOIN cov USING (_row))"""


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def quality_verdict() -> str:
    parts = [f"NOT {BASE_FAILED}"]
    for r in RULES:
        sides = []
        if r.low is not None:
            sides.append(f"100 * {r.metric} >= {r.low} * {r.per}")
        if r.high is not None:
            sides.append(f"100 * {r.metric} <= {r.high} * {r.per}")
        parts.append(f"(({' AND '.join(sides)}) OR n_words < {r.min_words})")
    return "(" + " AND ".join(parts) + ")"


QUALITY = f"""WITH {quality_features()}
SELECT doc_id, n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words, n_stop_words,
       {BASE_FAILED} AS base_failed, {quality_verdict()} AS kept
FROM feat"""

_weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
#: Targets only: which documents a source takes depends on the hash order, so those are tested by their sums.
MIXING_TARGETS = f"""
    sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, {MAX_EPOCHS} * source_size AS cap,
        CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % {len(WEIGHTS)} {_weight} END AS w FROM src),
    lev AS (SELECT *, cap / w AS ratio,
        ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    pick AS (SELECT arg_min(level, ratio) AS level FROM lev WHERE level * w < cap),
    target AS (SELECT source, source_size, CASE WHEN pick.level * w < cap THEN pick.level * w ELSE cap::DOUBLE END AS target
        FROM weighed, pick)"""

_P = "(1 + (1000000000::HUGEINT * ({count} + 1)) // ({n} + {v}))::HUGEINT"
DIVERGENCE = f"""WITH
    d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    tok AS (SELECT lang, source, row_id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS count FROM tok GROUP BY lang, term HAVING count(DISTINCT row_id) >= {LEAST_DOCS}),
    langs AS (SELECT lang, count(*) AS v, sum(count) AS n FROM kept GROUP BY lang),
    grp AS (SELECT DISTINCT lang, source FROM d),
    cnt AS (SELECT lang, source, term, count(*) AS count FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    tot AS (SELECT lang, source, sum(count) AS n FROM cnt GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c.count, 0) AS count,
            {_P.format(count="coalesce(c.count, 0)", n="coalesce(t.n, 0)", v="l.v")} AS p,
            {_P.format(count="k.count", n="l.n", v="l.v")} AS lang_p
        FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang)
        LEFT JOIN tot t USING (lang, source) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    same AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
        FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN same s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    above AS (SELECT lang, source, term AS item, (((p - lang_p) * (p - lang_p)) // lang_p)::BIGINT AS value FROM dense WHERE count > 0 AND p > lang_p),
    ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
        UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM above)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

WARC = f"""WITH
    p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    first AS (SELECT payload_digest, min(page_id) AS page_id FROM d WHERE payload_bytes >= {LEAST} GROUP BY 1)
SELECT d.page_id, d.url, payload_bytes, d.payload_digest,
    CASE WHEN first.page_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first.page_id <> d.page_id THEN first.page_id END AS refers_to
FROM d LEFT JOIN first ON first.payload_digest = d.payload_digest AND payload_bytes >= {LEAST}"""

JACCARD = f"""WITH RECURSIVE
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)"""

ORACLES: dict[str, str] = {"op3_warc": WARC, "op8_quality": QUALITY, "op9_jaccard_join": JACCARD, "op13_divergence": DIVERGENCE}
