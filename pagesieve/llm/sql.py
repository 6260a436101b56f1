"""What the registered queries must return, as SQL for DuckDB over the same tables.

Written from the contracts alone: none of it follows the operators' own steps. There is
none for byte-level BPE, patience alignment and the pipeline, which SQL cannot express;
their tests hold them against brute force.
"""

from __future__ import annotations

from pagesieve.llm import mixing, quality, url_rules

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Nodes and links (a, b) in both directions to the least node that can be reached.
_REACH = """
    reach AS (
        SELECT a AS node, a AS seen FROM links
        UNION
        SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
    ),
    least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

COVER_TREE = f"""
    WITH RECURSIVE sound AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    unit AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM sound),
    links AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y
        ON x.label = y.label AND x.vec_id <> y.vec_id
        AND list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.98
    ),
    {_REACH},
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least.component_id, vec_id) AS component_id,
           coalesce(least.component_id, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN least ON node = vec_id
"""

MINHASH = f"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _ASCII_LOWER.format("coalesce(text, '')"))} AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s
        FROM worded
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
    ),
    {_REACH}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
           coalesce(component_id, doc_id) = doc_id AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = doc_id
"""

WARC = """
    WITH payloads AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest
        FROM pages
    ),
    firsts AS (SELECT digest, min(page_id) AS first FROM payloads WHERE n >= 100 GROUP BY digest)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to
    FROM payloads LEFT JOIN firsts USING (digest)
"""

_CONTROL = r"'([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'"

CHAT = f"""
    WITH spoken AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
        FROM spoken
    ),
    sized AS (
        SELECT *, sum(length('[INST] ' || regexp_replace(role, {_CONTROL}) || ' [/INST]'
                             || regexp_replace(text, {_CONTROL}) || '</s>'))
                  OVER (PARTITION BY conv_id ORDER BY k) AS so_far,
               k = max(k) OVER (PARTITION BY conv_id) AS is_last
        FROM placed
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(so_far) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
"""


def _case(level: mixing.Level) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in level.weights.items())
    return f"CASE {level.name} {cases} ELSE {level.default} END"


def mix(levels: tuple[mixing.Level, ...], percent: int, epochs: int, seed: int) -> str:
    """Budgets by water-filling at each level, then a prefix of each leaf's last epoch."""
    values = ["'domain' || (TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT) % 4)", "lang", "source"]
    fields = ", ".join(f"{v} AS {level.name}" for v, level in zip(values, levels, strict=True))
    names = [level.name for level in levels]
    parts = [
        f"counted AS (SELECT doc_id, {fields}, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents)",
        f"budget0 AS (SELECT CAST(sum(n_tokens) * {percent} // 100 AS HUGEINT) AS budget FROM counted)",
    ]
    for depth, level in enumerate(levels):
        here = names[: depth + 1]
        above = " AND ".join(f"n.{x} IS NOT DISTINCT FROM p.{x}" for x in names[:depth]) or "true"
        group = ", ".join(names[:depth]) or "1"
        keys = ", ".join(here)
        parts += [
            f"node{depth} AS (SELECT {keys}, sum(n_tokens) * {epochs} AS cap, {_case(level)} AS w "
            f"FROM counted GROUP BY {keys})",
            f"""open{depth} AS (
                SELECT n.*, p.budget,
                       coalesce(sum(cap) OVER before, 0) AS full_before,
                       sum(w) OVER everyone - coalesce(sum(w) OVER before, 0) AS w_left
                FROM node{depth} n JOIN budget{depth} p ON {above}
                WINDOW everyone AS (PARTITION BY {", ".join("n." + x for x in names[:depth]) or "1"}),
                       before AS (PARTITION BY {", ".join("n." + x for x in names[:depth]) or "1"}
                                  ORDER BY cap / w, n.{level.name} NULLS FIRST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"""ordered{depth} AS (
                SELECT *, cap * w_left <= greatest(budget - full_before, 0) * w AS fills FROM open{depth})""",
            f"""level{depth} AS (
                SELECT *, min(struct_pack(r := cap / w, l := greatest(budget - full_before, 0), s := w_left))
                          FILTER (NOT fills) OVER (PARTITION BY {group}) AS edge FROM ordered{depth})""",
            f"""budget{depth + 1} AS (
                SELECT {keys}, CASE WHEN fills THEN cap ELSE edge.l * w // edge.s END AS budget FROM level{depth})""",
        ]
    same = " AND ".join(f"c.{x} IS NOT DISTINCT FROM b.{x}" for x in names)
    keys = ", ".join(f"c.{x}" for x in names)
    parts += [
        f"totals AS (SELECT {', '.join(names)}, sum(n_tokens) AS total FROM counted GROUP BY ALL)",
        f"""due AS (
            SELECT c.*, b.budget, coalesce(b.budget // nullif(t.total, 0), 0) AS whole,
                   coalesce(b.budget % nullif(t.total, 0), 0) AS rest
            FROM counted c JOIN budget{len(levels)} b ON {same}
            JOIN totals t ON {same.replace("b.", "t.")})""",
        f"""streamed AS (
            SELECT *, coalesce(sum(n_tokens) OVER (
                PARTITION BY {", ".join(names)}
                ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start
            FROM due)""",
    ]
    return f"""
        WITH {", ".join(parts)}
        SELECT doc_id, {", ".join(names)}, n_tokens, CAST(budget AS BIGINT) AS leaf_budget,
               CAST(whole + (start < rest)::INT AS BIGINT) AS copies
        FROM streamed
    """


def _distance(counts: str, reference: str) -> str:
    def part(p: str, q: str) -> str:
        return f"CASE WHEN {p} > 0 THEN {p} * log2({p} * 2 / ({p} + {q})) ELSE 0 END"

    pairs = f"list_zip({counts}, {reference})"
    p, q = f"(z[1] / list_sum({counts})::DOUBLE)", f"(z[2] / list_sum({reference})::DOUBLE)"
    terms = f"list_transform({pairs}, lambda z: {part(p, q)} + {part(q, p)})"
    return f"sqrt(greatest(list_sum({terms}) / 2, 0))"


def _in_class(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))".replace("'\"()-", "''\"()-")


QUALITY = f"""
    WITH worded AS (
        SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
    ),
    windows AS (
        SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
               unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS five
        FROM worded
    ),
    twice AS (
        SELECT doc_id, unnest(range(i, i + 5)) AS i
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1
    ),
    repeated AS (SELECT doc_id, count(DISTINCT i) AS n FROM twice GROUP BY doc_id),
    lines AS (
        SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (
            SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM worded
        ) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
    ),
    classed AS (
        SELECT doc_id, lang, t, w, length(regexp_replace(t, '[a-z ]', '', 'g')) AS residue,
               [{", ".join(_in_class(c) for c in quality.CLASSES.values())}] AS c
        FROM worded
    ),
    counted AS (
        SELECT doc_id, lang, w, list_concat(list_concat([length(t) - residue], c), [residue - list_sum(c)]) AS classes
        FROM classed
    ),
    totals AS (
        SELECT lang, sum(len(w)) AS total,
               [{", ".join(f"sum(classes[{i + 1}])" for i in range(len(quality.CLASSES) + 2))}] AS class_reference
        FROM counted GROUP BY lang
    ),
    common AS (
        SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM counted)
        GROUP BY lang, x
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {quality.COMMON_WORDS}
    ),
    tops AS (SELECT lang, list(x ORDER BY n DESC, x) AS xs, list(n ORDER BY n DESC, x) AS ns FROM common GROUP BY lang),
    known AS (
        SELECT t.lang, xs, class_reference, list_concat(ns, [total - list_sum(ns)]) AS word_reference
        FROM totals t JOIN tops p ON t.lang IS NOT DISTINCT FROM p.lang
        WHERE total >= {quality.GUARD_LANGUAGE_WORDS}
    ),
    compared AS (
        SELECT doc_id, w, classes, class_reference, word_reference,
               list_transform(xs, lambda x: len(list_filter(w, lambda y: y = x))) AS found
        FROM counted c LEFT JOIN known k ON c.lang IS NOT DISTINCT FROM k.lang
    ),
    distances AS (
        SELECT doc_id, CASE WHEN len(w) >= {quality.GUARD_WORDS} THEN {_distance("classes", "class_reference")} END AS by_class,
               CASE WHEN len(w) >= {quality.GUARD_WORDS}
                    THEN {_distance("list_concat(found, [len(w) - list_sum(found)])", "word_reference")} END AS by_word
        FROM compared
    ),
    base AS (
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM worded d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
    ),
    failing AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
    SELECT f.*, NOT base_failed AND NOT coalesce(
               by_class > {quality.MOST_CLASS_DISTANCE} OR by_word > {quality.MOST_WORD_DISTANCE}, false) AS kept
    FROM failing f JOIN distances USING (doc_id)
"""


def url_verdicts(rules: tuple[url_rules.ListedRule, ...], count_up_to: float) -> str:
    """Listed rules, and every token combination of the labelled urls that is a rule."""
    listed = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    names = lambda kind, parts: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{kind}:' || x)"
    tokens = "list_sort(list_distinct(" + " || ".join(
        [
            names("scheme", "[lower(regexp_extract(u, '(?s)^(.*?)://', 1))]"),
            names("host", "string_split(host, '.')"),
            names("path", "string_split(lower(path), '/')"),
            names("query", "list_transform(string_split(lower(regexp_extract(u, '(?s)^[^?#]*\\?([^#]*)', 1)), '&'), "
                  "lambda x: string_split(x, '=')[1])"),
        ]
    ) + "))"
    return f"""
        WITH listed(verdict, h, p) AS (VALUES {listed}),
        cut AS (
            SELECT page_id, url, coalesce(url, '') AS u,
                   {_ASCII_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ),
        parsed AS (SELECT *, {tokens} AS tokens FROM cut),
        marks AS (
            SELECT doc_id AS page_id, max(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id
        ),
        labelled AS (SELECT row_number() OVER () AS k, tokens, bad FROM parsed JOIN marks USING (page_id)),
        subsets AS (
            SELECT bad, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS needed
            FROM (SELECT k, tokens, bad, unnest(range(1, 1 << len(tokens))) AS mask FROM labelled)
        ),
        mined AS (
            SELECT needed FROM subsets GROUP BY needed
            HAVING count(*) FILTER (bad) >= ceil(greatest({url_rules.LEAST_SUPPORT}, least({count_up_to},
                       {url_rules.LEAST_COUNT} / (SELECT count(*) FROM labelled))) * (SELECT count(*) FROM labelled))
               AND count(*) FILTER (bad) / count(*) >= {url_rules.LEAST_CONFIDENCE}
        ),
        judged AS (
            SELECT page_id, host, path,
                   (SELECT arg_max(struct_pack(name := h || p, verdict := verdict), length(h || p)) FROM listed
                    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
                   url IS NOT NULL AND EXISTS (FROM mined WHERE list_has_all(tokens, needed)) AS mined
            FROM parsed
        )
        SELECT page_id, host, path, rule.name AS rule,
               coalesce(rule.verdict, CASE WHEN mined THEN 'block' ELSE 'allow' END) AS verdict, mined
        FROM judged
    """


SUFFIXES = """
    WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    starts AS (
        SELECT doc_id, i, b[i + 1:i + 50] AS s
        FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM bytes)
    ),
    firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
    covered AS (SELECT doc_id, i, i + 50 AS j FROM starts JOIN firsts USING (s) WHERE first < doc_id),
    grouped AS (
        SELECT *, sum(CASE WHEN i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
        FROM (SELECT *, lag(j, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) AS reach FROM covered)
    ),
    spans AS (SELECT doc_id, span, min(i) AS i, max(j) AS j FROM grouped GROUP BY ALL),
    gaps AS (
        SELECT doc_id, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY i), 0) AS a, i AS z FROM spans
        UNION ALL SELECT doc_id, max(j), 2147483647 FROM spans GROUP BY doc_id
    ),
    kept AS (
        SELECT doc_id, string_agg(hex(b[a + 1:z]), '' ORDER BY a) AS k
        FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
    ),
    counts AS (SELECT doc_id, sum(j - i) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(k), b)) AS kept_sha256
    FROM bytes LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
