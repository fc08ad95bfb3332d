"""Pieces of DuckDB SQL that say what the operators compute, written apart from their Spark form."""

from __future__ import annotations

from ..functions import lexicon


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def listed(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


SPACE = r"E' \t\r\n'"


def trim(x: str) -> str:
    return f"trim({x}, {SPACE})"


def spaced(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[ \t\r\n]+'), lambda w0: w0 <> '')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[A-Za-z][A-Za-z''\-]*')"


def letters(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z'']+')"


def sentences(x: str) -> str:
    return rf"""list_filter(list_transform(string_split(regexp_replace({trim(x)}, '([.!?])\s+([A-Z0-9"''(])', E'\\1\x01\\2', 'g'), E'\x01'), lambda s0: {trim("s0")}), lambda s0: s0 <> '')"""


def normalised(x: str) -> str:
    return spaced(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}''’ \t\r\n]+', ' ', 'g')")


def grams(tokens: str, n: int) -> str:
    """Distinct n-grams of a list column."""
    return f"list_distinct(list_transform(range(1, greatest(len({tokens}) - {n - 1}, 0) + 1), lambda i0: array_to_string({tokens}[i0:i0 + {n - 1}], ' ')))"


def not_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w1: NOT list_contains({listed(lexicon.STOPWORDS)}, w1))"


def content_set(x: str) -> str:
    return f"list_distinct(list_filter({not_stop(words(x))}, lambda w2: length(w2) > 1))"


def clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END"


SUFFIXES = [
    " Furthermore, we utilize robust tools — daily — and — often. Moreover, it is important to note that the approach plays a crucial role.",
    " Firstly, we tested it. Secondly, it broke. Finally, we fixed it.\n- one item\n- two items\n- three items\n- four items\n",
    " It runs. It works. It stops. We wait. We win. They are not treated as weak parts. It was built not for them but as a model of it.",
    " Innovation, sustainability, and commitment matter. The movement, statement, and permission count. In 1999 we sold 1,250 units at 12.5% off, not 300.",
    " The tool\u200b is\u202e odd\u00ad here. Perhaps it could be argued that Dr. Alice Brown met NASA in Paris, and we saw Alice.",
    " The data data data data shows data. The data is here. The data is big. The data wins. The data ends.",
    " It is not only fast but also cheap. In order to win, do not stop — ever — or — never. We don't know because it rains.",
    "",
]

DRAFTS = "SELECT doc_id, lang, source, text || CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SUFFIXES)) + " END AS text FROM documents"

def phrase_pattern(phrases: list[str]) -> str:
    return r"\b(?:" + "|".join(p.replace("-", r"\-") for p in sorted(phrases, key=len, reverse=True)) + r")\b"


#: Each tell by itself, where the operators look for all at once.
PATTERNS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(phrase_pattern(phrases))}, {quoted(label)}, {quoted(kind)}, {quoted(sev)})" for i, (label, phrases, _, kind, sev) in enumerate(lexicon.TELLS)) + ") p(i, pattern, label, kind, given)"
#: What any tell's phrase begins with, as a first look.
HEADS = r"\b(?:" + "|".join(sorted({p[:5] for t in lexicon.TELLS for p in t[1]})).replace("-", r"\-") + ")"

NOT_DONE = r"(?i)\b(?:it|this|that|these|those|they) (?:is|are|was|were) (?:not )?[a-z]+(?:ed|en|lt|ld|nt|de) (?:as|at|by|for|from|in|on|to|with)\b"
BUT_AS = r"(?i)\bnot(?: [a-z]+){1,6} but as\b"


def snip(x: str, limit: int = 80) -> str:
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE rtrim({x}[1:{limit - 1}]) || '…' END"


def checks(source: str, name: str) -> dict[str, str]:
    """CTEs over a relation source(k, text): name_s (k, text, s), name_tells, name_issues (k, kind, severity, snippet)."""
    marks, danger = quoted(lexicon.MARKS), quoted(lexicon.DANGEROUS_MARKS)
    n_marks, n_danger = (f"(length(text) - length(translate(text, {m}, '')))" for m in (marks, danger))
    lines = lambda pattern: f"len(list_filter(string_split(text, chr(10)), lambda x9: regexp_matches(x9, '{pattern}')))"
    listish, headingish = lines(r"^\s*(?:[-*•]|[0-9]+[.)])\s"), lines(r"^ {0,3}(?:#{1,3} |[A-Z][A-Za-z ]{3,}:\s*$)")
    runs = f"{name}_runs"
    return {
        f"{name}_s": f"SELECT k, text, {sentences('text')} AS s, len({words('text')}) AS nw FROM {source}",
        "patterns": PATTERNS,
        f"{name}_tells": f"SELECT k, i, label, kind, given, unnest(regexp_extract_all(lower(text), pattern)) AS m FROM (SELECT * FROM {source} WHERE regexp_matches(lower(text), {quoted(HEADS)})) src, patterns",
        f"{name}_each": f"SELECT k, nw, len(s) AS ns, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM {name}_s",
        f"{name}_short": f"SELECT k, ns, pos, sentence, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS island FROM {name}_each WHERE len({spaced('sentence')}) <= 5",
        runs: f"SELECT k, count(*) AS run, min(pos) AS start, string_agg(sentence, ' ' ORDER BY pos) AS joined FROM {name}_short WHERE ns >= 3 GROUP BY k, island QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(pos)) = 1",
        f"{name}_dash": f"SELECT k, length(text) - length(replace(text, '—', '')) AS dashes, len({spaced('text')}) AS n FROM {source}",
        f"{name}_first": rf"""SELECT k, nw, ns, trim(lower({spaced('sentence')}[1]), '“”"''(),.!?;:') AS w FROM {name}_each""",
        f"{name}_open": f"SELECT k, w, count(*) AS n, any_value(ns) AS ns FROM {name}_first WHERE ns >= 4 AND nw >= 30 AND w <> '' AND list_contains({listed(lexicon.COMMON_OPENERS)}, w) GROUP BY k, w",
        f"{name}_len": f"SELECT k, s, nw, list_transform(s, lambda x: len({spaced('x')})::DOUBLE) AS l FROM {name}_s",
        f"{name}_rep": f"SELECT k, w, count(*) AS n, any_value(ns) AS ns FROM (SELECT k, len(s) AS ns, unnest({not_stop('regexp_extract_all(lower(text), ' + quoted(chr(91) + 'a-zA-Z' + chr(39) + ']{4,}') + ')')}) AS w FROM {name}_s WHERE nw >= 30) GROUP BY k, w",
        f"{name}_ttr": f"SELECT k, len(list_distinct(w))::DOUBLE / len(w) AS ttr FROM (SELECT k, {words('text')} AS w FROM {name}_s WHERE nw >= 100)",
        f"{name}_triad": rf"SELECT k, unnest(list_zip(regexp_extract_all(text, '\b([A-Za-z]{{4,}}),\s+([A-Za-z]{{4,}}),\s+and\s+([A-Za-z]{{4,}})\b', 1), regexp_extract_all(text, '\b([A-Za-z]{{4,}}),\s+([A-Za-z]{{4,}}),\s+and\s+([A-Za-z]{{4,}})\b', 2), regexp_extract_all(text, '\b([A-Za-z]{{4,}}),\s+([A-Za-z]{{4,}}),\s+and\s+([A-Za-z]{{4,}})\b', 3))) AS g FROM {source}",
        f"{name}_issues": f"""
SELECT DISTINCT k, kind, severity, snippet FROM (
SELECT k, 'unicode' AS kind, CASE WHEN {n_danger} > 0 THEN 'high' ELSE 'medium' END AS severity, {n_marks}::VARCHAR AS snippet FROM {source} WHERE {n_marks} > 0
UNION ALL SELECT k, kind, coalesce(given, CASE WHEN len({spaced('m')}) > 1 THEN 'high' ELSE 'medium' END), {snip('m')} FROM {name}_tells
UNION ALL SELECT k, 'triad', 'low', g[1] || ', ' || g[2] || ', ' || g[3] FROM {name}_triad WHERE {' + '.join(f"regexp_matches(g[{i}], '(?:{chr(124).join(lexicon.ABSTRACT_ENDINGS)})$')::INT" for i in (1, 2, 3))} >= 2
UNION ALL SELECT k, 'staccato', 'low', {snip('joined', 60)} FROM {runs} WHERE run >= 3
UNION ALL SELECT k, 'punctuation', CASE WHEN dashes * 1000.0 / n >= 15 THEN 'medium' ELSE 'low' END, repeat('—', least(dashes, 8)::INT) FROM {name}_dash WHERE dashes >= 3 AND n > 0 AND dashes * 1000.0 / n >= 10
UNION ALL SELECT k, 'antithesis', 'low', {snip('sentence', 70)} FROM {name}_each WHERE regexp_matches(sentence, '(?i)\\bnot\\b') AND (regexp_matches(sentence, {quoted(NOT_DONE)}) OR regexp_matches(sentence, {quoted(BUT_AS)}))
UNION ALL SELECT k, 'listing', 'medium', array_to_string(f, ', ') FROM (SELECT k, list_filter({listed(lexicon.LIST_MARKERS)}, lambda m: len(list_filter(s, lambda x: starts_with(lower(x), m))) > 0) AS f FROM {name}_s) WHERE len(f) > 0
UNION ALL SELECT k, 'structure', 'medium', ({listish} + 2 * {headingish})::VARCHAR FROM {source} WHERE {listish} + 2 * {headingish} >= 4
UNION ALL SELECT k, 'short', 'low', nw::VARCHAR FROM {name}_s WHERE nw > 0 AND nw < 30
UNION ALL SELECT k, 'openers', CASE WHEN n::DOUBLE / ns >= 0.55 OR n >= 4 THEN 'high' ELSE 'medium' END, w FROM {name}_open WHERE n::DOUBLE / ns >= 0.5 OR n >= 3
UNION ALL SELECT k, 'rhythm', 'medium', round(list_avg(l))::INT::VARCHAR FROM {name}_len WHERE nw >= 30 AND len(l) >= 5 AND list_avg(l) > 0 AND list_stddev_samp(l) / list_avg(l) < 0.3
UNION ALL SELECT k, 'repetition', 'low', w FROM {name}_rep WHERE n >= 4 AND n >= ns
UNION ALL SELECT k, 'lexical', CASE WHEN ttr < 0.50 THEN 'medium' ELSE 'low' END, 'ttr' FROM {name}_ttr WHERE ttr < 0.56
)""".replace("\\\\b", "\\b"),
    }


#: The relations that queries name in `with_`.
DOCS = {
    "drafts": DRAFTS,
    "dk": "SELECT doc_id AS k, text FROM drafts",
    **checks("dk", "d"),
    "sl": f"SELECT doc_id, text, {sentences('text')} AS s FROM drafts",
    "sents": "SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence, len(s) AS n FROM sl",
    "sk": "SELECT doc_id * 1000000 + pos AS k, sentence AS text FROM sents",
    **checks("sk", "t"),
    "score": "SELECT dk.k AS doc_id, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 12 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 ELSE 0 END), 0))::INT AS score, count(*) FILTER (WHERE severity = 'high') AS n_high FROM dk LEFT JOIN d_issues USING (k) GROUP BY dk.k",
    "raw": "SELECT doc_id, pos, n, sentence, least(2, coalesce(sum(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END), 0))::INT AS w FROM sents LEFT JOIN t_issues ON t_issues.k = doc_id * 1000000 + pos GROUP BY ALL",
    "smooth": "SELECT doc_id, pos, n, sentence, w, CASE WHEN n < 2 THEN w WHEN 6 * w + 2 * l + 2 * r >= 14 THEN 2 WHEN 6 * w + 2 * l + 2 * r >= 6 THEN 1 ELSE 0 END AS label FROM (SELECT *, coalesce(lag(w) OVER p, w) AS l, coalesce(lead(w) OVER p, w) AS r FROM raw WINDOW p AS (PARTITION BY doc_id ORDER BY pos))",
    "regions": "SELECT doc_id, min(pos) AS start, max(pos) AS \"end\", count(*) AS count FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM smooth WHERE label = 2) GROUP BY doc_id, g HAVING count(*) >= 2",
    "dist": "SELECT doc_id, round_even(100.0 * count(*) FILTER (WHERE label = 0) / count(*), 0)::INT AS human, round_even(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 0)::INT AS mix, round_even(100.0 * count(*) FILTER (WHERE label = 2) / count(*), 0)::INT AS ai FROM smooth GROUP BY doc_id",
    "len": f"SELECT doc_id, s, list_transform(s, lambda x: len({spaced('x')})::DOUBLE) AS l FROM sl",
    "burst": "SELECT doc_id, CASE WHEN len(l) >= 5 THEN " + clamp("list_stddev_samp(l) / list_avg(l) / 0.6 * 100") + " END AS burstiness FROM len",
    "csets": f"SELECT doc_id, pos, n, {content_set('sentence')} AS c FROM sents",
    "pairs": "SELECT doc_id, c, lead(c) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM csets",
    "coh": "SELECT sl.doc_id, " + clamp("avg(CASE WHEN len(c) > 0 AND len(nx) > 0 THEN len(list_intersect(c, nx))::DOUBLE / least(len(c), len(nx)) END) * 200") + " AS coherence FROM sl LEFT JOIN pairs USING (doc_id) GROUP BY sl.doc_id",
    "freq": f"SELECT word, count(*) AS n FROM (SELECT unnest({letters('text')}) AS word FROM conversations) GROUP BY word",
    "logp": "SELECT word, n, -log2(n / sum(n) OVER ()) AS surprisal, row_number() OVER (ORDER BY n DESC, word) AS rank FROM freq",
    "ctok": f"SELECT doc_id, unnest(list_filter({not_stop(letters('text'))}, lambda w2: length(w2) > 1)) AS word FROM drafts",
    "choice": "SELECT doc_id, n, rare_share, mean_surprisal, CASE WHEN n >= 30 THEN " + clamp("0.55 * (152.0 - 300.0 * rare_share) + 0.45 * (644.0 - 41.0 * mean_surprisal)") + " END AS word_choice FROM (SELECT doc_id, count(*) AS n, sum((coalesce(rank, 5001) > 5000)::INT) / count(*) AS rare_share, avg(coalesce(surprisal, 18.0)) AS mean_surprisal FROM ctok LEFT JOIN logp USING (word) GROUP BY doc_id)",
    "synt": "SELECT dk.k AS doc_id, greatest(0, 100 - coalesce(t.p, 0) - coalesce(o.p, 0))::INT AS syntactic FROM dk LEFT JOIN (SELECT k, sum(CASE WHEN coalesce(given, CASE WHEN len(" + spaced("m") + ") > 1 THEN 'high' ELSE 'medium' END) = 'high' THEN 12 ELSE 6 END) AS p FROM d_tells GROUP BY k) t ON t.k = dk.k LEFT JOIN (SELECT k, 6 * count(*) AS p FROM d_issues WHERE kind IN ('punctuation', 'listing') GROUP BY k) o ON o.k = dk.k",
    "nwords": f"SELECT doc_id, len({words('text')}) AS n_words FROM drafts",
    "metrics": "SELECT doc_id, score, human, mix, ai, burstiness, coherence, word_choice, syntactic, n_words, ((burstiness IS NOT NULL)::INT + (coherence IS NOT NULL)::INT + (word_choice IS NOT NULL)::INT) / 3.0 AS coverage FROM score JOIN dist USING (doc_id) JOIN burst USING (doc_id) JOIN coh USING (doc_id) LEFT JOIN choice USING (doc_id) JOIN synt USING (doc_id) JOIN nwords USING (doc_id)",
    "bq": f"SELECT doc_id, w, CASE WHEN len(w) < 40 THEN 4 ELSE 8 END AS n FROM (SELECT doc_id, {normalised('text')} AS w FROM documents)",
    "q": f"SELECT doc_id, n, len(w) AS n_words, CASE WHEN n = 4 THEN {grams('w', 4)} ELSE {grams('w', 8)} END AS g FROM bq",
    "br": f"SELECT item_id, {normalised('text')} AS w FROM benchmark",
    "idx": f"SELECT item_id AS ref_id, 4 AS n, unnest({grams('w', 4)}) AS gram FROM br UNION ALL SELECT item_id, 8, unnest({grams('w', 8)}) FROM br",
    "cont": "SELECT doc_id, ref_id, n, count(*) AS shared, query_grams, round_even(count(*) * 100.0 / query_grams, 0)::INT AS score FROM (SELECT doc_id, n, len(g) AS query_grams, unnest(g) AS gram FROM q) JOIN idx USING (n, gram) GROUP BY doc_id, ref_id, n, query_grams",
    "hist": "SELECT conv_id * 1000 + turn AS id, conv_id * 60 + turn AS ts, role AS style, text AS output, sha256(trim(regexp_replace(lower(trim(text, E' \\t\\r\\n')), '[ \\t\\r\\n]+', ' ', 'g'))) AS output_key, length(text)::DOUBLE AS score FROM conversations",
}


def needed(body: str) -> list[str]:
    """Names of DOCS that a query needs, in the order of DOCS."""
    import re

    found: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in DOCS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\()", text):
                found.add(name)
                todo.append(DOCS[name])
    return [n for n in DOCS if n in found]


def with_(body: str) -> str:
    names = needed(body)
    return ("WITH " + ",\n".join(f"{n} AS ({DOCS[n]})" for n in names) + "\n" if names else "") + body


def with_variants(body: str) -> str:
    """A query over vk (k, doc_id, v, before, text), the edit variants of the drafts, with their issues, scores and plainness."""
    long = "replace(replace(replace(replace(text, 'don''t', 'do not'), 'isn''t', 'is not'), 'can''t', 'cannot'), 'it''s', 'it is')"
    each = ["text", r"regexp_replace(text, '\. (It|The|We) ', ', and \1 ', 'g')", "replace(replace(text, ' get ', ' obtain '), ' use ', ' employ ')", long]
    stops = f"SELECT unnest({listed(lexicon.STOPWORDS)})"
    relations = {
        "drafts": DRAFTS,
        "vk": " UNION ALL ".join(f"SELECT doc_id * 10 + {v} AS k, doc_id, {v}::BIGINT AS v, text AS before, {new} AS text FROM drafts" for v, new in enumerate(each)),
        **checks("vk", "v"),
        "vscore": DOCS["score"].replace("dk", "vk").replace("d_issues", "v_issues").replace("vk.k AS doc_id", "vk.k AS k"),
        "freq": DOCS["freq"],
        "vplain": f"SELECT k, coalesce(sum((word IN (SELECT word FROM freq UNION {stops}))::INT)::DOUBLE / nullif(count(word), 0), 1) AS plain FROM (SELECT k, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS word FROM (SELECT k, {letters('text')} AS t FROM vk)) GROUP BY k",
    }
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in relations.items()) + "\n" + body
