"""SQL for DuckDB of the queries on spelling, manifests and licences, see ``sql.py``."""

from __future__ import annotations

from pagesieve.llm import license_scan, spelling
from pagesieve.llm.sql import _ASCII_LOWER

#: The table of CRC-32 as a list ``t`` in the one row of ``crc``.
_CRC_TABLE = """
    crc AS (
        SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
                    ORDER BY k) AS t
        FROM (SELECT CAST(range AS BIGINT) AS k FROM range(256))
    )
"""


def _crc32(data: str) -> str:
    """CRC-32 of the list ``data`` of bytes; ``t`` is the table."""
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}),
        lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])))"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _levels(name: str, source: str) -> str:
    """``source`` (tree, pos, n, digest) as level 0 and all levels above it."""
    return f"""
    {name} AS (
        SELECT tree, CAST(0 AS BIGINT) AS level, pos, n, digest FROM {source}
        UNION ALL
        SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
        FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n
    )
    """


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = _FIELDS.replace("CAST(text AS", f"CAST({_ASCII_LOWER.format('text')} AS")
_SPAN = "CAST(pow(8, s.level) AS BIGINT)"

MERKLE = f"""
    WITH RECURSIVE {_CRC_TABLE},
    digests AS (
        SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS}) AS leaf,
               CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")} % 3 = 0
                    THEN sha256({_TAMPERED}) END AS claim
        FROM documents, crc
    ),
    leaves AS (
        SELECT *, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n,
               row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM digests
    ),
    {_levels("lower_nodes", "leaves")},
    tops AS (
        SELECT tree AS lang_tree, '' AS tree, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY tree) - 1 AS pos
        FROM lower_nodes WHERE n = 1
    ),
    {_levels("upper_nodes", "tops")},
    asked AS (
        SELECT row_number() OVER () AS id, l.*, t.pos AS tree_pos, t.digest AS subroot
        FROM leaves l JOIN tops t ON l.tree = t.lang_tree
    ),
    others AS (
        SELECT id, 0 AS part, s.level, s.pos, s.digest, s.pos < a.pos // {_SPAN} AS left_of
        FROM asked a JOIN lower_nodes s ON s.tree = a.tree AND s.n > 1
             AND s.pos // 8 = a.pos // (8 * {_SPAN}) AND s.pos <> a.pos // {_SPAN}
        UNION ALL
        SELECT id, 1, s.level, s.pos, s.digest, s.pos < a.tree_pos // {_SPAN}
        FROM asked a JOIN upper_nodes s ON s.n > 1
             AND s.pos // 8 = a.tree_pos // (8 * {_SPAN}) AND s.pos <> a.tree_pos // {_SPAN}
    ),
    proof AS (SELECT id, string_agg(digest, '' ORDER BY part, level, pos) AS siblings FROM others GROUP BY id),
    heights AS (SELECT tree, count(DISTINCT level) - 1 AS up FROM lower_nodes GROUP BY tree),
    steps AS (
        SELECT id, part, level,
               coalesce(string_agg(digest, '' ORDER BY pos) FILTER (left_of), '') AS before,
               coalesce(string_agg(digest, '' ORDER BY pos) FILTER (NOT left_of), '') AS after
        FROM others GROUP BY id, part, level
    ),
    folded AS (
        SELECT id, a.tree, CAST(0 AS BIGINT) AS step, coalesce(claim, leaf) AS digest FROM asked a
        UNION ALL
        SELECT f.id, f.tree, f.step + 1, sha256(coalesce(before, '') || digest || coalesce(after, ''))
        FROM folded f JOIN heights h ON h.tree = f.tree
        LEFT JOIN steps s ON s.id = f.id AND s.part = CASE WHEN f.step < h.up THEN 0 ELSE 1 END
             AND s.level = CASE WHEN f.step < h.up THEN f.step ELSE f.step - h.up END
        WHERE f.step < h.up + (SELECT max(level) FROM upper_nodes)
    ),
    last AS (SELECT id, max_by(digest, step) AS folded_root FROM folded GROUP BY id)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
           folded_root, folded_root = root AS verified
    FROM asked JOIN last USING (id) LEFT JOIN proof USING (id),
         (SELECT digest AS root FROM upper_nodes WHERE n = 1)
"""

_WORDS = rf"regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RULES = ", ".join(
    f"""({r.order}, {r.priority}, {r.confidence}, {f"'{r.label}'" if r.label else "NULL"}, '{r.pattern}')"""
    for r in license_scan.rules()
)
_PHRASES = ", ".join(f"({p.split()}, '{label}')" for p, label in license_scan.PHRASES.items())

#: The rules run on every document here, whatever keywords it has.
LICENSES = f"""
    WITH worded AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
    base AS (
        SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
               list(DISTINCT label) AS base_list
        FROM (
            SELECT id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS place
            FROM worded, (VALUES {_PHRASES}) AS p(phrase, label)
        ) GROUP BY id
    ),
    lines AS (SELECT id, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS line FROM worded),
    hits AS (
        SELECT id, line, r.*, regexp_extract_all(line, pattern) AS hits
        FROM lines, (VALUES {_RULES}) AS r(rule, priority, confidence, label, pattern)
        WHERE regexp_matches(line, pattern)
    ),
    counted AS (SELECT *, string_split_regex(line, pattern) AS gaps, unnest(range(1, len(hits) + 1)) AS k FROM hits),
    found AS (
        SELECT id, rule, priority, confidence, label,
               list_sum(list_transform(gaps[1:k], lambda x: len(x)))
               + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: len(x))), 0) AS start,
               len(hits[k]) AS size
        FROM counted
    ),
    kept AS (
        SELECT id, confidence, label FROM found d WHERE label IS NOT NULL AND NOT EXISTS (
            FROM found e WHERE e.id = d.id AND e.start <= d.start AND e.start + e.size >= d.start + d.size
            AND (e.priority, e.size, -e.rule) > (d.priority, d.size, -d.rule)
        )
    ),
    labelled AS (SELECT id, list(DISTINCT label) AS rule_list, max(confidence) AS best FROM kept GROUP BY id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(list_sort(base_list), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(
               list_concat(coalesce(base_list, []), coalesce(rule_list, [])))), ','), '') AS labels,
           coalesce(best, 0) / 100 AS score
    FROM worded LEFT JOIN base USING (id) LEFT JOIN labelled USING (id)
"""

_BYTES = """flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)]
    ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))"""

#: Words without one code point, as keys: equal keys are words one edit apart.
SPELLING = f"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (
        SELECT doc_id, run, count(*) AS m FROM (
            SELECT doc_id, {_ASCII_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run
            FROM documents
        ) WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL
    ),
    hashed AS (SELECT run, m, {_crc32(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs, crc),
    written AS (
        SELECT CASE WHEN h % {spelling.SPOIL} = 0
                    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m
        FROM hashed
    ),
    counts AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM written GROUP BY word),
    words AS (
        SELECT word, n FROM counts
        WHERE n >= {spelling.LEAST_COUNT} AND length(word) >= {spelling.LEAST_LENGTH}
    ),
    less AS (
        SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest
        FROM (SELECT word, unnest(range(length(word))) AS k FROM words)
    ),
    near AS (
        SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.k = y.k AND x.rest = y.rest AND x.word <> y.word
        UNION SELECT x.word, y.word FROM less x JOIN words y ON x.rest = y.word
        UNION SELECT y.word, x.word FROM less x JOIN words y ON x.rest = y.word
    ),
    placed AS (
        SELECT a, b, w.n, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near
        FROM near JOIN words w ON w.word = b
    ),
    forms AS (
        SELECT w.word, CASE WHEN p.n >= {spelling.TIMES} * w.n THEN b END AS form, w.n,
               coalesce(n_near, 0) AS n_near, CASE WHEN p.n >= {spelling.TIMES} * w.n THEN p.n END AS form_n
        FROM words w LEFT JOIN placed p ON p.a = w.word AND p.k = 1
    ),
    chains AS (
        SELECT word, word AS reached, 0 AS step FROM forms
        UNION ALL
        SELECT c.word, f.form, step + 1 FROM chains c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL
    ),
    roots AS (SELECT word, max_by(reached, step) AS root FROM chains GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
