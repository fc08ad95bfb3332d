"""Queries by catalogue id, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import diff, evaluate, facts, issues, overlap, passages, signals, state, transforms, verdict
from ..sources import files
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, whole: bool = False):
    """Registers a query; its SQL may name relations of S.DOCS, unless it is whole as it stands."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle if whole else S.with_(oracle)
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; texts of a file too small to be split are dealt to all cores, as each costs far more than its shuffle.

    This changes where rows are computed, not what: a table of as many splits as cores, as any large one, is not moved.
    """
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """documents with a sentence or two after each text, so that every rule has something to find."""
    suffix = F.lit(None).cast("string")
    for i, s in enumerate(S.SUFFIXES):
        suffix = F.when(F.col("doc_id") % 8 == i, s).otherwise(suffix)
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat("text", suffix).alias("text"))


def sents(spark: SparkSession, d: str) -> DataFrame:
    return drafts(spark, d).select("doc_id", "text", T.sentences(F.col("text")).alias("s"))


def rounded(x, n: int = 6):
    return F.round(x, n)


# Sentences, tokens, text functions


@query("P01_sentences", "SELECT doc_id, pos, sentence FROM sents")
def p01(spark, d):
    return sents(spark, d).select("doc_id", F.posexplode("s").alias("pos", "sentence"))


@query("D03_tokenizers", f"SELECT doc_id, len({S.spaced('text')}) AS n_spaced, len({S.words('text')}) AS n_words, len({S.letters('text')}) AS n_letters, len(regexp_extract_all(lower(text), '[a-zA-Z'']{{4,}}')) AS n_long, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n_alnum, len({S.normalised('text')}) AS n_norm FROM drafts")
def d03(spark, d):
    t = F.col("text")
    each = {"n_spaced": T.spaced(t), "n_words": T.words(t), "n_letters": T.letters(t), "n_long": T.long_words(t), "n_alnum": T.alphanumeric(t), "n_norm": T.normalised(t)}
    return drafts(spark, d).select("doc_id", *[F.size(v).cast("long").alias(k) for k, v in each.items()])


@query("P02_snippet", f"SELECT doc_id, {S.snip(S.trim('text'))} AS snippet FROM drafts")
def p02(spark, d):
    return drafts(spark, d).select("doc_id", T.snippet(T.trimmed(F.col("text"))).alias("snippet"))


@query("P03_allowlist", "SELECT k AS doc_id, label, m AS matched, count(*) AS n, count(*) FILTER (WHERE i IN (" + ", ".join(str(i) for i, t in enumerate(lexicon.TELLS) if t[0] in ("consequently", "in conclusion")) + ")) AS n_allowed FROM d_tells GROUP BY ALL")
def p03(spark, d):
    """Allow-listed are the academic style's phrases, which here are whole matches of two patterns."""
    phrases = lexicon.STYLES[0][1]
    some = drafts(spark, d).where(F.lower("text").rlike(lexicon.ANY_TELL)).withColumn("spans", issues.allowed_spans(F.col("text"), phrases))
    told = some.select("doc_id", issues.allowed(F.col("text"), F.col("spans")).alias("ok"), F.explode(issues.tells(F.col("text"))).alias("t"))
    return told.groupBy("doc_id", "t.label", "t.matched").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("ok", F.col("t.place")).cast("long")).alias("n_allowed"))


@query("P04_P05_tells", f"SELECT k AS doc_id, label, kind, coalesce(given, CASE WHEN len({S.spaced('m')}) > 1 THEN 'high' ELSE 'medium' END) AS severity, m AS matched, count(*) AS n FROM d_tells GROUP BY ALL")
def p05(spark, d):
    rows = drafts(spark, d).select("doc_id", F.explode(issues.tells(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id", "t.label", "t.kind", "t.severity", "t.matched").agg(F.count(F.lit(1)).alias("n"))


@query("J04_pattern_join", "SELECT label, count(DISTINCT k) AS n_docs, count(*) AS n_hits FROM d_tells GROUP BY label")
def j04(spark, d):
    """The theta join of texts with the pattern table: a literal table of patterns, so its columns are in the row."""
    rows = drafts(spark, d).select("doc_id", F.explode(issues.tells(F.col("text"))).alias("t")).groupBy("doc_id", "t.label").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_hits"))


@query("P06_triads", "SELECT k AS doc_id, snippet FROM d_issues WHERE kind = 'triad'")
def p06(spark, d):
    return drafts(spark, d).select("doc_id", F.explode(F.array_distinct(issues.triads(F.col("text")))).alias("snippet"))


@query("P07_W02_staccato", "SELECT k AS doc_id, run, start, CASE WHEN length(joined) <= 60 THEN joined ELSE rtrim(joined[1:59]) || '…' END AS snippet FROM d_runs WHERE run >= 3")
def p07(spark, d):
    run = issues.staccato(F.col("s"))
    rows = sents(spark, d).select("doc_id", "s", run.alias("r")).where("r IS NOT NULL")
    joined = F.array_join(F.slice("s", F.col("r.start") + 1, F.col("r.run")), " ")
    return rows.select("doc_id", F.col("r.run").cast("long").alias("run"), F.col("r.start").cast("long").alias("start"), T.snippet(joined, 60).alias("snippet"))


_MARKS, _DANGER = S.quoted(lexicon.MARKS), S.quoted(lexicon.DANGEROUS_MARKS)


@query("P08_marks", f"SELECT doc_id, length(text) - length(translate(text, {_MARKS}, '')) AS n_marks, length(text) - length(translate(text, {_DANGER}, '')) AS n_danger FROM drafts WHERE length(text) > length(translate(text, {_MARKS}, ''))")
def p08(spark, d):
    t = F.col("text")
    out = drafts(spark, d).select("doc_id", signals.mark_count(t).cast("long").alias("n_marks"), signals.mark_count(t, lexicon.DANGEROUS_MARKS).cast("long").alias("n_danger"))
    return out.where("n_marks > 0")


@query("P09_T00_strip_marks", f"SELECT doc_id, translate(text, {_MARKS}, '') AS text FROM drafts")
def p09(spark, d):
    return drafts(spark, d).select("doc_id", transforms.strip_marks(F.col("text")).alias("text"))


@query("A26_mark_classes", "SELECT name, danger, sum(n)::BIGINT AS n FROM (SELECT name, danger, length(text) - length(replace(text, c, '')) AS n FROM drafts, (VALUES " + ", ".join(f"({S.quoted(chr(c))}, {S.quoted(n)}, {str(g).lower()})" for c, n, g in lexicon.INVISIBLE) + ") m(c, name, danger)) GROUP BY name, danger HAVING sum(n) > 0")
def a26(spark, d):
    marks = spark.createDataFrame([(chr(c), n, g) for c, n, g in lexicon.INVISIBLE], "c string, name string, danger boolean")
    t = F.col("text")
    chars = drafts(spark, d).where(signals.mark_count(t) > 0).select(F.explode(F.split(F.regexp_replace(t, f"[^{lexicon.MARKS}]", ""), "")).alias("c"))
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(marks), "c").select("name", "danger", "n")


@query("P10_emdash", "SELECT k AS doc_id, dashes, n AS words, CASE WHEN dashes >= 3 AND dashes * 1000.0 / n >= 10 THEN CASE WHEN dashes * 1000.0 / n >= 15 THEN 'medium' ELSE 'low' END END AS severity FROM d_dash WHERE dashes > 0")
def p10(spark, d):
    dashes, n, severity = issues.emdashes(F.col("text"))
    return drafts(spark, d).select("doc_id", dashes.cast("long").alias("dashes"), n.cast("long").alias("words"), severity.alias("severity")).where("dashes > 0")


@query("P11_antithesis", "SELECT k AS doc_id, snippet FROM d_issues WHERE kind = 'antithesis'")
def p11(spark, d):
    return sents(spark, d).select("doc_id", F.explode(F.array_distinct(F.transform(issues.antitheses(F.col("s")), lambda s: T.snippet(s, 70)))).alias("snippet"))


@query("P12_list_markers", "SELECT k AS doc_id, snippet AS markers FROM d_issues WHERE kind = 'listing'")
def p12(spark, d):
    out = sents(spark, d).select("doc_id", F.array_join(issues.list_markers(F.col("s")), ", ").alias("markers"))
    return out.where("markers <> ''")


@query("P13_structure", "SELECT k AS doc_id, snippet::INT AS shape FROM d_issues WHERE kind = 'structure'")
def p13(spark, d):
    a, b = issues.structure_shape(F.col("text"))
    return drafts(spark, d).select("doc_id", (a + 2 * b).alias("shape")).where("shape >= 4")


@query("P14_short", "SELECT doc_id, n_words FROM nwords WHERE n_words > 0 AND n_words < 30")
def p14(spark, d):
    return drafts(spark, d).select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words")).where("n_words > 0 AND n_words < 30")


@query("P15_content_words", f"SELECT doc_id, len(c) AS n, array_to_string(list_sort(c), ' ') AS words FROM (SELECT doc_id, {S.content_set('text')} AS c FROM drafts)")
def p15(spark, d):
    c = signals.content_words(F.col("text"))
    return drafts(spark, d).select("doc_id", F.size(c).cast("long").alias("n"), F.array_join(F.sort_array(c), " ").alias("words"))


_NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all({}, '[0-9]+(?:[.,][0-9]+)?%?'), lambda x: regexp_replace(x, '([0-9]),([0-9])', '\1\2', 'g'))))"


@query("P16_numbers", f"SELECT doc_id, array_to_string({_NUMBERS.format('text')}, ' ') AS numbers FROM drafts")
def p16(spark, d):
    return drafts(spark, d).select("doc_id", F.array_join(signals.number_tokens(F.col("text")), " ").alias("numbers"))


_NEGATIONS = rf"len(list_filter(regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_'']+'), lambda w: list_contains({S.listed(lexicon.NEGATIONS)}, w) OR ends_with(w, 'n''t')))"


@query("P17_negations", f"SELECT doc_id, {_NEGATIONS.format('text')} AS n FROM drafts")
def p17(spark, d):
    return drafts(spark, d).select("doc_id", signals.negations(F.col("text")).cast("long").alias("n"))


@query("P18_entities", f"""SELECT doc_id, coalesce(string_agg(DISTINCT e, ' ' ORDER BY e) FILTER (WHERE e <> '' AND NOT list_contains({S.listed(lexicon.NON_ENTITIES)}, e)), '') AS entities FROM (
SELECT doc_id, CASE WHEN i = 1 OR (regexp_matches(t[i - 1], '[.!?]["'')]*$') AND NOT list_contains({S.listed(facts.ABBREVIATIONS)}, lower(t[i - 1]))) THEN '' ELSE regexp_extract(t[i], '^[^A-Za-z]*([A-Z][a-z]{{2,}}|[A-Z]{{2,}})[^A-Za-z]*$', 1) END AS e
FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {S.spaced('text')} AS t FROM drafts))) GROUP BY doc_id""")
def p18(spark, d):
    return drafts(spark, d).select("doc_id", F.array_join(facts.entities(F.col("text")), " ").alias("entities"))


_STYLE = "CASE doc_id % 5 WHEN 0 THEN 'business' WHEN 1 THEN 'casual' WHEN 2 THEN 'creative' WHEN 3 THEN 'unheard of' END"
_STYLES = "(VALUES " + ", ".join(f"({S.quoted(n)}, {a}, {b}, {str(k).lower()}, {str(c).lower()})" for n, _, a, b, k, c in lexicon.STYLES) + ") s(name, min_words, max_words, keep_structure, contractions)"


@query("P19_J10_style", f"SELECT doc_id, name AS style, min_words, max_words, keep_structure, contractions FROM (SELECT doc_id, {_STYLE} AS asked FROM documents), {_STYLES} WHERE name = CASE WHEN asked IN ({', '.join(S.quoted(s[0]) for s in lexicon.STYLES)}) THEN asked ELSE '{lexicon.DEFAULT_STYLE}' END")
def p19(spark, d):
    styles = spark.createDataFrame([(n, a, b, k, c) for n, _, a, b, k, c in lexicon.STYLES], "style string, min_words int, max_words int, keep_structure boolean, contractions boolean")
    asked = table(spark, d, "documents").select("doc_id", F.expr(_STYLE).alias("asked"))
    known = asked.select("doc_id", F.when(F.col("asked").isin([s[0] for s in lexicon.STYLES]), F.col("asked")).otherwise(lexicon.DEFAULT_STYLE).alias("style"))
    return known.join(F.broadcast(styles), "style").select("doc_id", "style", "min_words", "max_words", "keep_structure", "contractions")


@query("P20_clamped", "SELECT event_id, greatest(0.0, least(1.0, coalesce(value, 50.0) / 100.0)) AS intensity, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'standard' END AS mode FROM events")
def p20(spark, d):
    mode = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("standard")
    return table(spark, d, "events").select("event_id", T.clamped(F.coalesce("value", F.lit(50.0)) / 100.0, 0.0, 1.0).alias("intensity"), mode.alias("mode"))


_STIFF = sorted({w for w in [*lexicon.WORD_SWAPS, *lexicon.PLAIN_SWAPS] if w.isalpha()})


@query("P21_guidance", f"SELECT doc_id, array_to_string(w[1:8], ' ') AS stiff FROM (SELECT doc_id, list_filter({S.listed(_STIFF)}, lambda k: list_contains({S.words('text')}, k)) AS w FROM drafts) WHERE len(w) > 0")
def p21(spark, d):
    found = F.array_intersect(signals.word_set(_STIFF), T.words(F.col("text")))  # one pass; in the order of _STIFF
    return drafts(spark, d).select("doc_id", F.array_join(F.slice(found, F.lit(1), F.lit(8)), " ").alias("stiff")).where("stiff <> ''")


@query("P22_fingerprint", f"SELECT doc_id, sha256(regexp_replace(lower({S.trim('text')}), '[ \\t\\r\\n]+', ' ', 'g')) AS output_key FROM drafts")
def p22(spark, d):
    return drafts(spark, d).select("doc_id", state.fingerprint(F.col("text")).alias("output_key"))


@query("P23_file_stem", "SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '^.*/', ''), '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'text') AS stem FROM pages")
def p23(spark, d):
    stem = F.btrim(F.regexp_replace(F.regexp_replace("url", "^.*/", ""), "[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(stem, F.lit("")), F.lit("text")).alias("stem"))


# Joins with vocabulary


def logp(spark, d):
    return signals.surprisal_table(table(spark, d, "conversations"))


@query("A17_vocabulary", "SELECT word, n FROM freq")
def a17(spark, d):
    return table(spark, d, "conversations").select(F.explode(T.letters(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("J01_surprisal", "SELECT doc_id, n, round(mean_surprisal, 6) AS mean_surprisal FROM choice")
def j01(spark, d):
    return signals.word_choice(drafts(spark, d), logp(spark, d)).select("doc_id", "n", rounded(F.col("mean_surprisal")).alias("mean_surprisal"))


@query("J02_rare_words", "SELECT doc_id, count(*) AS n_rare FROM ctok WHERE word NOT IN (SELECT word FROM logp WHERE rank <= 5000) GROUP BY doc_id")
def j02(spark, d):
    rows = signals.tokens_of(drafts(spark, d), signals.content_tokens(F.col("text"))).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    return rows.join(logp(spark, d).where("rank <= 5000").select("word"), "word", "left_anti").groupBy("doc_id").agg(F.sum("c").alias("n_rare"))


@query("J03_everyday_words", "SELECT doc_id, count(*) AS n_everyday FROM ctok WHERE word IN (SELECT word FROM freq) GROUP BY doc_id")
def j03(spark, d):
    rows = signals.tokens_of(drafts(spark, d), signals.content_tokens(F.col("text"))).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    return rows.join(logp(spark, d).select("word"), "word", "left_semi").groupBy("doc_id").agg(F.sum("c").alias("n_everyday"))


@query("J11_M16_swap_safety", f"SELECT w AS word FROM (SELECT unnest({S.listed(_STIFF)}) AS w) WHERE w IN (SELECT word FROM freq)")
def j11(spark, d):
    return spark.createDataFrame([(w,) for w in _STIFF], "word string").join(logp(spark, d).select("word"), "word", "left_semi")


# Aggregates and signals


@query("A01_length_stats", "SELECT doc_id, len(s) AS n_sentences, round(coalesce(list_avg(l), 0), 6) AS mean_length, round(CASE WHEN len(l) < 2 THEN 0 ELSE coalesce(list_stddev_samp(l) / nullif(list_avg(l), 0), 0) END, 6) AS cv FROM len")
def a01(spark, d):
    mean, cv = signals.length_stats(F.col("s"))
    return sents(spark, d).select("doc_id", F.size("s").cast("long").alias("n_sentences"), rounded(mean).alias("mean_length"), rounded(cv).alias("cv"))


@query("A02_openers", "SELECT k AS doc_id, severity, snippet AS opener FROM d_issues WHERE kind = 'openers'")
def a02(spark, d):
    rows = sents(spark, d).where(F.size(T.words(F.col("text"))) >= 30).select("doc_id", F.explode(issues.openers(F.col("s"))).alias("i"))
    return rows.select("doc_id", "i.severity", F.col("i.snippet").alias("opener"))


@query("A03_rhythm", "SELECT k AS doc_id, snippet AS mean_length FROM d_issues WHERE kind = 'rhythm'")
def a03(spark, d):
    mean, cv = signals.length_stats(F.col("s"))
    flat = (F.size("s") >= 5) & (cv < 0.3) & (mean > 0) & (F.size(T.words(F.col("text"))) >= 30)
    return sents(spark, d).where(flat).select("doc_id", F.round(mean).cast("int").cast("string").alias("mean_length"))


@query("A04_O04_repetition", "SELECT k AS doc_id, w AS word, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, w) AS rank FROM d_rep WHERE n >= 4 AND n >= ns")
def a04(spark, d):
    rows = signals.repetitions(drafts(spark, d).where(F.size(T.words(F.col("text"))) >= 30))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")).cast("long"))


@query("A05_type_token_ratio", "SELECT k AS doc_id, round(ttr, 6) AS ttr, CASE WHEN ttr < 0.50 THEN 'medium' WHEN ttr < 0.56 THEN 'low' END AS severity FROM d_ttr")
def a05(spark, d):
    rows = drafts(spark, d).where(F.size(T.words(F.col("text"))) >= 100).select("doc_id", signals.type_token_ratio(F.col("text")).alias("ttr"))
    return rows.select("doc_id", rounded(F.col("ttr")).alias("ttr"), F.when(F.col("ttr") < 0.50, "medium").when(F.col("ttr") < 0.56, "low").alias("severity"))


@query("A06_A07_compression")
def a06(spark, d):
    """Spark and SQL have no deflate, so this one is held against zlib in the tests."""
    rows = drafts(spark, d).select("doc_id", signals.compression_ratio(F.col("text")).alias("ratio"))
    return rows.select("doc_id", "ratio", signals.perplexity(F.col("ratio")).alias("perplexity"))


@query("A08_burstiness", "SELECT doc_id, round(burstiness, 6) AS burstiness FROM burst")
def a08(spark, d):
    return sents(spark, d).select("doc_id", rounded(signals.burstiness(F.col("s"))).alias("burstiness"))


@query("A09_syntactic", "SELECT doc_id, syntactic FROM synt")
def a09(spark, d):
    return sents(spark, d).select("doc_id", issues.syntactic(F.col("text"), F.col("s")).cast("int").alias("syntactic"))


@query("A10_word_choice", "SELECT doc_id, n, round(rare_share, 6) AS rare_share, round(word_choice, 5) AS word_choice FROM choice")
def a10(spark, d):
    return signals.word_choice(drafts(spark, d), logp(spark, d)).select("doc_id", "n", rounded(F.col("rare_share")).alias("rare_share"), rounded(F.col("word_choice"), 5).alias("word_choice"))


@query("A11_J07_W06_coherence", "SELECT doc_id, round(coherence, 6) AS coherence FROM coh")
def a11(spark, d):
    return sents(spark, d).select("doc_id", rounded(signals.coherence(F.col("s"))).alias("coherence"))


def doc_issues(spark, d, **how):
    return issues.issues(drafts(spark, d), **how)


@query("A12_issues", "SELECT k AS doc_id, kind, severity, snippet FROM d_issues")
def a12(spark, d):
    return doc_issues(spark, d).select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.kind", "i.severity", "i.snippet")


@query("A13_naturalness", "SELECT doc_id, score, n_high FROM score")
def a13(spark, d):
    high = F.size(F.filter("issues", lambda i: i["severity"] == "high")).cast("long")
    return doc_issues(spark, d).select("doc_id", issues.naturalness(F.col("issues")).alias("score"), high.alias("n_high"))


@query("O03_top_issues", "SELECT k AS doc_id, kind, snippet, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, kind, snippet) AS rn FROM d_issues) WHERE rn <= 6")
def o03(spark, d):
    weight = F.when(F.col("i.severity") == "high", 0).when(F.col("i.severity") == "medium", 1).otherwise(2)
    rows = doc_issues(spark, d).select("doc_id", F.explode("issues").alias("i"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(weight, "i.kind", "i.snippet")).cast("long")
    return rows.select("doc_id", "i.kind", "i.snippet", rank.alias("rank")).where("rank <= 6")


@query("A15_coverage")
def a15(spark, d):
    """Share of the four measured signals; compressibility has no SQL, so this is held against plain Python."""
    rows = drafts(spark, d).select("doc_id", "text", T.sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", signals.burstiness(F.col("s")).alias("b"), signals.coherence(F.col("s")).alias("c"), signals.compression_ratio(F.col("text")).alias("ratio"))
    rows = rows.join(signals.word_choice(drafts(spark, d), logp(spark, d)).select("doc_id", "word_choice"), "doc_id", "left")
    return rows.select("doc_id", rounded(verdict.coverage(signals.perplexity(F.col("ratio")), F.col("b"), F.col("c"), F.col("word_choice"))).alias("coverage"))


@query("A15_coverage_without_compression", "SELECT doc_id, round(coverage, 6) AS coverage FROM metrics")
def a15_sql(spark, d):
    return metrics(spark, d).select("doc_id", rounded(F.col("coverage")).alias("coverage"))


_STOP_ROWS = f"SELECT unnest({S.listed(lexicon.STOPWORDS)}) AS word"


@query("A16_plain_register", f"SELECT doc_id, round(coalesce(sum((word IN (SELECT word FROM freq UNION {_STOP_ROWS}))::INT)::DOUBLE / nullif(count(word), 0), 1), 6) AS plain FROM (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS word FROM (SELECT doc_id, {S.letters('text')} AS t FROM drafts)) GROUP BY doc_id")
def a16(spark, d):
    """Everyday words are those of the corpus of human prose and the stop words."""
    return signals.plain_register(drafts(spark, d), everyday(spark, d)).select("doc_id", rounded(F.col("plain")).alias("plain"))


@query("A17_everyday_words", f"SELECT word FROM freq UNION {_STOP_ROWS}")
def everyday(spark, d):
    return signals.everyday_words(table(spark, d, "conversations"))


# Passages


def labels(spark, d):
    return passages.labelled(drafts(spark, d))


@query("W05_sentence_weights", "SELECT doc_id, pos, w FROM raw")
def w05(spark, d):
    return labels(spark, d).select("doc_id", F.posexplode("raw").alias("pos", "w"))


@query("W01_smoothed_labels", "SELECT doc_id, pos, CASE label WHEN 0 THEN 'human' WHEN 1 THEN 'mix' ELSE 'ai' END AS label FROM smooth")
def w01(spark, d):
    return labels(spark, d).select("doc_id", F.posexplode("weights").alias("pos", "w")).select("doc_id", "pos", passages.named(F.col("w")).alias("label"))


@query("W03_regions", 'SELECT doc_id, start, "end", count FROM regions')
def w03(spark, d):
    rows = labels(spark, d).select("doc_id", F.explode(passages.regions(F.col("weights"))).alias("r"))
    return rows.select("doc_id", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("start", "end", "count")])


@query("W04_long_regions", 'SELECT doc_id, count(*) AS n FROM regions WHERE count >= 3 GROUP BY doc_id')
def w04(spark, d):
    return labels(spark, d).select("doc_id", F.size(passages.regions(F.col("weights"), 3)).cast("long").alias("n")).where("n > 0")


@query("A14_distribution", "SELECT doc_id, human, mix, ai FROM dist")
def a14(spark, d):
    rows = labels(spark, d).where(F.size("weights") > 0)
    return rows.select("doc_id", *[passages.distribution(F.col("weights"), i).alias(n) for i, n in enumerate(passages.NAMES)])


# Verdicts


def metrics(spark, d, compress: bool = False):
    """All signals of a document, in one pass over the texts and one aggregation of words.

    Compressibility, which SQL cannot say, is measured only if asked for; coverage is then over four signals, else three.
    """
    docs = drafts(spark, d)
    base = docs.select("doc_id", "text", T.sentences(F.col("text")).alias("s"))
    ratio = signals.compression_ratio(F.col("text")) if compress else F.lit(None).cast("double")
    base = base.withColumn("ratio", ratio)
    found = issues.distinct_issues(issues.checks(F.col("text"), F.col("s"), ratio=F.col("ratio") if compress else None))
    weights = passages.smoothed(passages.raw_weights(F.col("s")))
    rows = base.withColumns({"issues": found, "weights": weights, "perplexity": signals.perplexity(F.col("ratio"))})
    rows = rows.withColumns({
        "score": issues.naturalness(F.col("issues")),
        "n_high": F.size(F.filter("issues", lambda i: i["severity"] == "high")),
        "human": passages.distribution(F.col("weights"), 0),
        "ai": passages.distribution(F.col("weights"), 2),
        "long_regions": F.size(passages.regions(F.col("weights"), 3)),
        "n_regions": F.size(passages.regions(F.col("weights"))),
        "burstiness": signals.burstiness(F.col("s")),
        "coherence": signals.coherence(F.col("s")),
        "syntactic": issues.syntactic(F.col("text"), F.col("s")),
        "n_words": F.size(T.words(F.col("text"))),
        "has_list": F.exists("issues", lambda i: i["kind"] == "structure"),
    })
    words = signals.word_choice(docs, logp(spark, d)).select("doc_id", "word_choice")
    rows = rows.drop("text", "s").join(words, "doc_id", "left")
    measured = ["burstiness", "coherence", "word_choice", *(["perplexity"] if compress else [])]
    return rows.withColumn("coverage", verdict.coverage(*map(F.col, measured)))


_KEY = "sha256(trim(regexp_replace(lower(trim(text, E' \\t\\r\\n')), '[ \\t\\r\\n]+', ' ', 'g')))"
_PLAIN = "CASE WHEN human >= 70 AND score >= 70 THEN 'human' WHEN human >= 40 AND score >= 50 THEN 'mixed' ELSE 'ai' END"
_DETECT = f"""SELECT doc_id, score, human, ai, CASE WHEN unsure THEN 'uncertain' ELSE plain END AS verdict,
CASE WHEN unsure THEN least(confidence, 45) WHEN plain = 'human' THEN least(confidence, 70) ELSE confidence END AS confidence FROM (
SELECT *, reasons > 0 AND NOT (plain = 'ai' AND (score <= 25 OR ai >= 75)) AS unsure,
greatest(30, least(99, round_even(base * (0.7 + 0.3 * coverage), 0)::INT)) AS confidence FROM (
SELECT *, CASE plain WHEN 'human' THEN greatest(40, least(99, score)) WHEN 'ai' THEN greatest(40, least(99, 100 - score)) ELSE 62 END AS base FROM (
SELECT *, {_PLAIN} AS plain, (n_words < 30)::INT + (doc_id IN (SELECT k FROM d_issues WHERE kind = 'structure'))::INT + (coverage = 0)::INT AS reasons FROM metrics)))"""


def judged(rows):
    """rows of metrics with reasons to abstain, the verdict and its confidence."""
    rows = rows.withColumn("reasons", verdict.abstain_reasons(F.col("n_words"), F.col("has_list"), F.col("coverage")))
    told, confidence = verdict.verdict(F.col("score"), F.col("human"), F.col("ai"), F.col("coverage"), F.col("reasons"))
    return rows.withColumns({"verdict": told, "confidence": confidence})


@query("M02_M03_detect", _DETECT)
def m02(spark, d):
    """The verdict on the three signals that SQL can say; M02_detect has all four."""
    return judged(metrics(spark, d)).select("doc_id", "score", "human", "ai", "verdict", "confidence")


@query("M02_detect")
def m02_full(spark, d):
    """The verdict with all that it rests on: signals, distribution, regions, reasons to abstain."""
    rows = judged(metrics(spark, d, compress=True))
    shown = [rounded(F.col(c)).alias(c) for c in ("perplexity", "burstiness", "coherence", "word_choice", "coverage")]
    return rows.select("doc_id", "score", "human", "ai", "n_regions", "syntactic", *shown, F.array_join("reasons", " ").alias("reasons"), "verdict", "confidence")


@query("M04_override", f"SELECT doc_id, CASE WHEN known THEN 'ai_derived' ELSE verdict END AS verdict, CASE WHEN known THEN 99 ELSE confidence END AS confidence FROM ({_DETECT}) JOIN (SELECT doc_id, {_KEY} IN (SELECT {_KEY} FROM drafts WHERE doc_id % 3 = 0) AS known FROM drafts) USING (doc_id)")
def m04(spark, d):
    """A text that the history has as an output is derived, whatever its style; a third of the drafts are in it."""
    docs = drafts(spark, d)
    told = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts"), state.fingerprint(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("output_key"))
    rows = m02(spark, d).join(state.generated(docs, told), "doc_id", "left")
    told, confidence = verdict.derived(F.col("verdict"), F.col("confidence"), F.col("entry"))
    return rows.select("doc_id", told.alias("verdict"), confidence.alias("confidence"))


@query("M01_analyze")
def m01(spark, d):
    """Score, issues by severity, and the metrics that they rest on."""
    n = lambda severity: F.size(F.filter("issues", lambda i: i["severity"] == severity))
    mean, cv = signals.length_stats(F.col("s"))
    rows = sents(spark, d).withColumn("ratio", signals.compression_ratio(F.col("text")))
    rows = rows.withColumn("issues", issues.distinct_issues(issues.checks(F.col("text"), F.col("s"), ratio=F.col("ratio"))))
    return rows.select("doc_id", issues.naturalness(F.col("issues")).alias("score"), F.size("issues").alias("n_issues"), *[n(x).alias(f"n_{x}") for x in ("high", "medium", "low")],
                       F.size(T.words(F.col("text"))).alias("n_words"), F.size("s").alias("n_sentences"), rounded(mean).alias("mean_length"), rounded(cv).alias("cv"), rounded(signals.type_token_ratio(F.col("text"))).alias("ttr"))


@query("M05_percent_band", "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 75 THEN 'AI' WHEN value >= 50 THEN 'likely AI' WHEN value >= 25 THEN 'mixed' ELSE 'human' END AS band FROM events")
def m05(spark, d):
    return table(spark, d, "events").select("event_id", verdict.percent_band(F.col("value")).alias("band"))


_WEAK = "list_filter([CASE WHEN burstiness < {0} THEN 'burstiness' END, CASE WHEN syntactic < {1} THEN 'syntactic' END, CASE WHEN word_choice < {2}{3} THEN 'word_choice' END], lambda x: x IS NOT NULL)"


@query("M10_weak_bands", f"SELECT doc_id, array_to_string({_WEAK.format(50, 70, 40, ' AND syntactic < 70')}, ' ') AS weak FROM metrics")
def m10(spark, d):
    weak = verdict.weak_bands(F.col("burstiness"), F.col("syntactic"), F.lit(None).cast("double"), F.col("word_choice"))
    return metrics(spark, d).select("doc_id", F.array_join(weak, " ").alias("weak"))


@query("M11_A23_bench_gate", f"SELECT signal, count(*) AS n FROM (SELECT unnest({_WEAK.format(50, 75, 55, '')}) AS signal FROM metrics) GROUP BY signal")
def m11(spark, d):
    weak = verdict.weak_bands(F.col("burstiness"), F.col("syntactic"), F.lit(None).cast("double"), F.col("word_choice"), (50, 75, 50, 55), False)
    return evaluate.weak_histogram(metrics(spark, d).withColumn("weak", weak), "weak")


@query("A23_pass_rate", f"SELECT count(*) AS n, round(avg((score >= 75 AND len({_WEAK.format(50, 75, 55, '')}) = 0)::INT), 6) AS pass_rate FROM metrics")
def a23(spark, d):
    weak = verdict.weak_bands(F.col("burstiness"), F.col("syntactic"), F.lit(None).cast("double"), F.col("word_choice"), (50, 75, 50, 55), False)
    return metrics(spark, d).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(((F.col("score") >= 75) & (F.size(weak) == 0)).cast("int"))).alias("pass_rate"))


@query("M09_gate", f"SELECT doc_id, score >= 80 AND len({_WEAK.format(50, 70, 40, ' AND syntactic < 70')}) = 0 AND doc_id NOT IN (SELECT doc_id FROM regions WHERE count >= 3) AS converged FROM metrics")
def m09(spark, d):
    weak = verdict.weak_bands(F.col("burstiness"), F.col("syntactic"), F.lit(None).cast("double"), F.col("word_choice"))
    return metrics(spark, d).select("doc_id", verdict.converged(F.col("score"), weak, F.col("long_regions"), F.lit(1.0), F.lit(0)).alias("converged"))


@query("M10_M11_weak_signals")
def m10_full(spark, d):
    """Weak bands of the loop and of the bench, with compressibility among them."""
    of = [F.col(c) for c in ("burstiness", "syntactic", "perplexity", "word_choice")]
    rows = metrics(spark, d, compress=True)
    return rows.select("doc_id", F.array_join(verdict.weak_bands(*of), " ").alias("weak"), F.array_join(verdict.weak_bands(*of, (50, 75, 50, 55), False), " ").alias("bench_weak"))


@query("M09_converged")
def m09_full(spark, d):
    """The loop's gate on what it asks for: score, four bands, regions, plain register and numbers lost by the rewrite."""
    rows = metrics(spark, d, compress=True)
    weak = verdict.weak_bands(*[F.col(c) for c in ("burstiness", "syntactic", "perplexity", "word_choice")])
    rows = rows.select("doc_id", "score", weak.alias("weak"), "long_regions").join(a16(spark, d), "doc_id")
    lost = facts.lost(signals.number_tokens(F.col("text")), signals.number_tokens(transforms.rewrite(F.col("text"))))
    rows = rows.join(drafts(spark, d).select("doc_id", F.size(lost).alias("n_lost")), "doc_id")
    return rows.select("doc_id", "score", F.array_join("weak", " ").alias("weak"), "long_regions", "plain", "n_lost", verdict.converged(F.col("score"), F.col("weak"), F.col("long_regions"), F.col("plain"), F.col("n_lost")).alias("converged"))


# Facts


def edited(spark, d):
    """drafts and an edit of each: numbers rounded off in some, a "not" dropped or a name lost in others."""
    t = F.col("text")
    after = F.when(F.col("doc_id") % 3 == 0, F.replace(t, F.lit("1,250"), F.lit("many"))).when(F.col("doc_id") % 3 == 1, F.replace(F.replace(t, F.lit(" not "), F.lit(" ")), F.lit("n't"), F.lit(""))).otherwise(F.replace(t, F.lit("Alice"), F.lit("they")))
    return drafts(spark, d).select("doc_id", t.alias("before"), after.alias("after"))


_EDITED = "(SELECT doc_id, text AS before, CASE doc_id % 3 WHEN 0 THEN replace(text, '1,250', 'many') WHEN 1 THEN replace(replace(text, ' not ', ' '), 'n''t', '') ELSE replace(text, 'Alice', 'they') END AS after FROM drafts)"


@query("J08_M06_preservation", f"SELECT doc_id, 'high' AS severity, 'number' AS kind, unnest(list_filter({_NUMBERS.format('before')}, lambda x: NOT list_contains({_NUMBERS.format('after')}, x))) AS snippet FROM {_EDITED} e1 UNION ALL SELECT doc_id, 'medium', 'negation', a || ' to ' || b FROM (SELECT doc_id, {_NEGATIONS.format('before')} AS a, {_NEGATIONS.format('after')} AS b FROM {_EDITED} e2) WHERE (a > 0) <> (b > 0)")
def m06(spark, d):
    found = facts.preservation_issues(F.col("before"), F.col("after"))
    rows = edited(spark, d).select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")
    return rows.where("kind <> 'entity'")


@query("O07_lost_entities")
def o07(spark, d):
    """Names lost by the edits, sorted; P18 has the SQL of their extraction."""
    return edited(spark, d).select("doc_id", F.array_join(facts.lost(facts.entities(F.col("before")), facts.entities(F.col("after"))), " ").alias("lost")).where("lost <> ''")


# Overlap


@query("A18_reuse", f"SELECT doc_id, round(coalesce(len(list_intersect(a, b)) * 100.0 / nullif(len(a), 0), 0), 6) AS reuse FROM (SELECT doc_id, {S.grams('x', 5)} AS a, {S.grams('y', 5)} AS b FROM (SELECT doc_id, regexp_extract_all(lower(before), '[a-z0-9'']+') AS x, regexp_extract_all(lower(after), '[a-z0-9'']+') AS y FROM {_EDITED} e3))")
def a18(spark, d):
    return edited(spark, d).select("doc_id", rounded(overlap.reuse(F.col("before"), F.col("after"))).alias("reuse"))


@query("M08_retry", f"SELECT doc_id, nw >= 35 AND coalesce(len(list_intersect(a, b)) * 100.0 / nullif(len(a), 0), 0) > 20 AS retry FROM (SELECT doc_id, nw, {S.grams('x', 5)} AS a, {S.grams('y', 5)} AS b FROM (SELECT doc_id, len({S.spaced('before')}) AS nw, regexp_extract_all(lower(before), '[a-z0-9'']+') AS x, regexp_extract_all(lower(after), '[a-z0-9'']+') AS y FROM {_EDITED} e3))")
def m08(spark, d):
    return edited(spark, d).select("doc_id", ((F.size(T.spaced(F.col("before"))) >= 35) & (overlap.reuse(F.col("before"), F.col("after")) > 20)).alias("retry"))


@query("A19_J05_W07_containment", "SELECT doc_id, ref_id, n, shared, query_grams, score FROM cont")
def a19(spark, d):
    out = overlap.containment(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id")
    return out.select("doc_id", "ref_id", "n", "shared", F.col("query_grams").cast("long").alias("query_grams"), "score")


@query("M12_overlap", "SELECT doc_id, n_words, coalesce(m, 0) AS score, CASE WHEN coalesce(m, 0) >= 50 THEN 'high' WHEN coalesce(m, 0) >= 20 THEN 'medium' ELSE 'low' END AS verdict FROM q LEFT JOIN (SELECT doc_id, max(score) AS m FROM cont GROUP BY doc_id) USING (doc_id)")
def m12(spark, d):
    out = overlap.overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id")
    return out.withColumn("n_words", F.col("n_words").cast("long"))


@query("J06_spans", f"""SELECT doc_id, pos, sentence, coalesce(array_to_string(refs, ','), '') AS refs FROM (
SELECT doc_id, pos, any_value(sentence) AS sentence, list_sort(list(ref_id) FILTER (WHERE ref_id IS NOT NULL AND c >= 0.5 * total)) AS refs FROM (
SELECT s.doc_id, s.pos, s.sentence, s.total, ref_id, count(*) AS c FROM hit s GROUP BY ALL) GROUP BY doc_id, pos
) JOIN (SELECT doc_id, pos FROM hit GROUP BY doc_id, pos, total HAVING count(DISTINCT gram) >= 0.5 * total) USING (doc_id, pos)""".replace("hit s", "h_ s").replace("FROM hit", "FROM h_"))
def j06(spark, d):
    return overlap.spans(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id")


_SPANS = f"""h_ AS (SELECT doc_id, pos, sentence, total, gram, ref_id FROM (
SELECT doc_id, pos, sentence, n, len(g) AS total, unnest(g) AS gram FROM (
SELECT doc_id, pos, sentence, n, CASE WHEN n = 4 THEN {S.grams('w', 4)} ELSE {S.grams('w', 8)} END AS g FROM (
SELECT doc_id, n, pos, sentence, {S.normalised('sentence')} AS w FROM (
SELECT d.doc_id, n, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents) d JOIN q USING (doc_id))) WHERE len(w) >= 4)) JOIN idx USING (n, gram))"""
ORACLES["J06_spans"] = S.with_("SELECT * FROM q JOIN idx USING (n)").rsplit("SELECT * FROM q JOIN", 1)[0].rstrip() + ",\n" + _SPANS + "\n" + ORACLES["J06_spans"]


@query("U01_U02_U03_sets", "SELECT (SELECT count(*) FROM (SELECT gram FROM idx INTERSECT SELECT unnest(g) FROM q)) AS n_common, (SELECT count(*) FROM (SELECT gram FROM idx UNION SELECT unnest(g) FROM q)) AS n_union, (SELECT count(*) FROM (SELECT gram FROM idx EXCEPT SELECT unnest(g) FROM q)) AS n_only_refs")
def u01(spark, d):
    a = overlap.index(table(spark, d, "benchmark"), "item_id").select("gram")
    b = overlap.grams_of(table(spark, d, "documents"), "doc_id").select(F.explode("grams").alias("gram"))
    sides = a.select("gram", F.lit(1).alias("side")).union(b.select("gram", F.lit(2))).groupBy("gram").agg(F.bit_or("side").alias("side"))
    n = lambda *v: F.count(F.when(F.col("side").isin(*v), 1))
    return sides.agg(n(3).alias("n_common"), n(1, 2, 3).alias("n_union"), n(1).alias("n_only_refs"))


# Rewriting


def staged(stage):
    return lambda spark, d: drafts(spark, d).select("doc_id", stage(F.col("text")).alias("text"))


def _alternation(words: dict[str, str]) -> str:
    out = "text"
    for w, o in words.items():
        out = f"regexp_replace({out}, '(^|[.!?] ){w.capitalize()}\\b', '\\1{o.capitalize()}', 'g')"
    return out


query("T02_conditional_transitions", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(^|, |\band )(?:in turn|as such),? ', '\1', 'g'), ' moving forward', '', 'g') AS text FROM drafts")(staged(transforms.conditional_transitions))
query("T03_transition_openers", f"SELECT doc_id, {_alternation(lexicon.TRANSITION_SWAPS)} AS text FROM drafts")(staged(transforms.transition_openers))
query("T09_dashes", r"SELECT doc_id, regexp_replace(text, '\s*—\s*', ', ', 'g') AS text FROM drafts")(staged(transforms.without_dashes))
query("T05_capitals", f"SELECT doc_id, array_to_string(list_transform({S.sentences('text')}, lambda s: upper(s[1:1]) || s[2:]), ' ') AS text FROM drafts")(staged(transforms.capitalised))
query("T07_both_and", rf"SELECT doc_id, array_to_string(list_transform({S.sentences('text')}, lambda s: regexp_replace(s, '^((?s:.*?))\bnot only ([^,.;]+?),? but (?:also )?', '\1both \2 and ')), ' ') AS text FROM drafts")(staged(transforms.both_and))
query("T08_dehedged", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^((?s:.*?))\bit could be argued that ', '\1'), '^((?s:.*?))\bperhaps ', '\1'), '^((?s:.*?))\bgenerally speaking,? ', '\1') AS text FROM drafts")(staged(transforms.dehedged))
query("T18_finished", f"""SELECT doc_id, CASE WHEN j = '' OR regexp_matches(j, '[.!?]["'')]?$') THEN j ELSE j || '.' END AS text FROM (SELECT doc_id, array_to_string(s, ' ') AS j FROM sl)""")(staged(transforms.finished))
query("T01_phrase_swaps")(staged(transforms.phrase_swaps))
query("T04_word_swaps")(staged(transforms.word_swaps))
query("T06_plain_register")(staged(transforms.plain_register))
query("T10_varied_openers")(staged(lambda t: transforms.varied_openers(F.col("doc_id"), t, 0.8)))
query("T11_asides")(staged(lambda t: transforms.asides(F.col("doc_id"), t, 0.8)))
query("T12_varied_length")(staged(lambda t: transforms.varied_length(F.col("doc_id"), t, 0.8, 6, 32)))
query("T13_diversified")(staged(lambda t: transforms.diversified(F.col("doc_id"), t)))
query("T14_forced_rhythm")(staged(transforms.forced_rhythm))
query("T15_fronted")(staged(lambda t: transforms.fronted(F.col("doc_id"), t, 0.8)))
query("T16_synonyms")(staged(lambda t: transforms.synonyms(F.col("doc_id"), t, 0.8)))
query("T17_contractions")(staged(lambda t: transforms.contractions(F.col("doc_id"), t, 0.8)))


@query("M07_rewrite")
def m07(spark, d):
    """Rewrites each draft, reverts where a number got lost, and scores both."""
    rows = drafts(spark, d).select("doc_id", F.col("text").alias("before"), transforms.rewrite(F.col("text")).alias("out"))
    lost = facts.lost(signals.number_tokens(F.col("before")), signals.number_tokens(F.col("out")))
    rows = rows.withColumn("text", F.when(F.size(lost) > 0, F.col("before")).otherwise(F.col("out")))
    score = lambda t: issues.naturalness(issues.distinct_issues(issues.checks(F.col(t), T.sentences(F.col(t)))))
    return rows.select("doc_id", "text", (F.size(lost) > 0).alias("reverted"), score("before").alias("before"), score("text").alias("after"))


@query("X01_word_diff")
def x01(spark, d):
    rows = drafts(spark, d).select("doc_id", "text", transforms.without_dashes(F.col("text")).alias("after"))
    return rows.select("doc_id", diff.word_diff(F.col("text"), F.col("after")).alias("ops"))


@query("X02_reconstructed", r"SELECT doc_id, text AS before, regexp_replace(text, '\s*—\s*', ', ', 'g') AS after FROM drafts")
def x02(spark, d):
    ops = F.col("ops")
    return x01(spark, d).select("doc_id", diff.reconstructed(ops, "del").alias("before"), diff.reconstructed(ops, "add").alias("after"))


# Evaluation and ranking


@query("A20_confusion", "SELECT tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS negative_accuracy FROM (SELECT count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE NOT a AND NOT p) AS tn, count(*) FILTER (WHERE a AND NOT p) AS fn FROM (SELECT quality = 0 AS a, score < 70 AS p FROM labels JOIN score USING (doc_id)))")
def a20(spark, d):
    rows = a13(spark, d).join(table(spark, d, "labels"), "doc_id")
    out = evaluate.confusion(rows, F.col("quality") == 0, F.col("score") < 70)
    return out.select("tp", "fp", "tn", "fn", *[rounded(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1", "negative_accuracy")])


@query("A22_by_language", "SELECT lang, count(*) AS n, round(avg((score < 70)::INT), 6) AS flagged FROM score JOIN documents USING (doc_id) GROUP BY lang")
def a22(spark, d):
    rows = a13(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg((F.col("score") < 70).cast("int"))).alias("flagged"))


@query("A21_lift")
def a21(spark, d):
    rows = m07(spark, d).select((F.col("doc_id") % 8).alias("seed"), "before", "after")
    return evaluate.lift(rows, "seed")


@query("M15_edit_variants", r"SELECT doc_id, variant, text FROM (SELECT doc_id, 'original' AS variant, text FROM drafts UNION ALL SELECT doc_id, 'merged', regexp_replace(text, '\. (It|The|We) ', ', and \1 ', 'g') FROM drafts UNION ALL SELECT doc_id, 'formal', replace(replace(text, ' get ', ' obtain '), ' use ', ' employ ') FROM drafts UNION ALL SELECT doc_id, 'long', replace(replace(replace(replace(text, 'don''t', 'do not'), 'isn''t', 'is not'), 'can''t', 'cannot'), 'it''s', 'it is') FROM drafts)")
def m15(spark, d):
    return evaluate.edit_variants(drafts(spark, d))


@query("M14_A24_robustness")
def m14(spark, d):
    v = evaluate.distinct_edits(drafts(spark, d)).withColumn("s", T.sentences(F.col("text")))
    found = issues.distinct_issues(issues.checks(F.col("text"), F.col("s")))
    v = v.select("variants", "s", found.alias("issues"))
    flags = v.select("variants", issues.naturalness(F.col("issues")).alias("score"), F.size(F.filter("issues", lambda i: i["severity"] == "high")).alias("n_high"), F.size(passages.regions(passages.smoothed(passages.raw_weights(F.col("s"))))).alias("n_regions"))
    return evaluate.clean_rate(flags.withColumn("variant", F.explode("variants")), "variant")


_CANDIDATES = f"""SELECT doc_id, v AS cand_id, score, plain, hard_drift, reuse,
len(list_filter({_NUMBERS.format('before')}, lambda x: NOT list_contains({_NUMBERS.format('text')}, x))) AS fact_lost FROM (
SELECT *, (({_NEGATIONS.format('before')} > 0) <> ({_NEGATIONS.format('text')} > 0))::INT AS hard_drift, coalesce(len(list_intersect(ga, gb)) * 100.0 / nullif(len(ga), 0), 0) AS reuse FROM (
SELECT *, {S.grams('x', 5)} AS ga, {S.grams('y', 5)} AS gb FROM (
SELECT *, regexp_extract_all(lower(before), '[a-z0-9'']+') AS x, regexp_extract_all(lower(text), '[a-z0-9'']+') AS y FROM vk JOIN vscore USING (k) JOIN vplain USING (k))))"""


def candidates(spark, d):
    """The edit variants of each draft as candidates, each with its score, plainness, and what it lost of the draft."""
    docs = drafts(spark, d)
    number = lambda v: F.array_position(F.array(*map(F.lit, ("original", "merged", "formal", "long"))), v) - 1
    rows = evaluate.distinct_edits(docs).withColumn("cand_ids", F.transform("variants", number))
    before, after = F.col("before"), F.col("text")
    found = issues.distinct_issues(issues.checks(after, T.sentences(after)))
    rows = rows.withColumns({
        "doc": F.col("doc_id"),
        "doc_id": F.col("doc_id") * 10 + F.get("cand_ids", F.lit(0)),
        "score": issues.naturalness(found),
        "fact_lost": F.size(facts.lost(signals.number_tokens(before), signals.number_tokens(after))),
        "hard_drift": ((signals.negations(before) > 0) != (signals.negations(after) > 0)).cast("int"),
        "reuse": overlap.reuse(before, after),
    })
    plain = signals.plain_register(rows.select("doc_id", "text"), everyday(spark, d))
    rows = rows.drop("text", "before", "variants").join(plain, "doc_id").drop("doc_id").withColumnRenamed("doc", "doc_id")
    return rows.withColumn("cand_id", F.explode("cand_ids")).drop("cand_ids")


@query("O01_best_of", S.with_variants(f"SELECT doc_id, cand_id, row_number() OVER (PARTITION BY doc_id ORDER BY hard_drift, round(reuse, 6), score DESC, cand_id)::INT AS rank FROM ({_CANDIDATES})"), whole=True)
def o01(spark, d):
    return evaluate.best_of(candidates(spark, d).withColumn("reuse", rounded(F.col("reuse"))), "doc_id").select("doc_id", "cand_id", "rank")


@query("O02_W09_M13_compared", S.with_variants(f"SELECT doc_id, cand_id, score, fact_lost, rank, rank = 1 AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (score >= 75) DESC, score DESC, round(plain, 6) DESC, fact_lost, cand_id)::INT AS rank FROM ({_CANDIDATES}))"), whole=True)
def o02(spark, d):
    return evaluate.compared(candidates(spark, d).withColumn("plain", rounded(F.col("plain"))), "doc_id").select("doc_id", "cand_id", "score", "fact_lost", "rank", "best")


# State


def history(spark, d):
    t = table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 60 + F.col("turn")).alias("ts"), F.col("role").alias("style"), F.col("text").alias("output"), state.fingerprint(F.col("text")).alias("output_key"), F.length("text").cast("double").alias("score"))


@query("S11_O05_history", "SELECT id, ts, style, output_key, score FROM hist ORDER BY ts DESC, id DESC LIMIT 100")
def s11(spark, d):
    return state.newest(history(spark, d)).select("id", "ts", "style", "output_key", "score")


@query("S12_public_history", "SELECT id, ts, style, score FROM hist")
def s12(spark, d):
    return state.public(history(spark, d))


@query("S11_removed", "SELECT id FROM hist WHERE style <> 'user'")
def s11b(spark, d):
    h = history(spark, d)
    return state.without(h, h.where("style = 'user'").select("id")).select("id")


@query("S11_appended", "SELECT id, ts, style, output_key, length(output) AS n_chars FROM hist UNION ALL SELECT -event_id - 1, floor(epoch(ts))::BIGINT, event_type, sha256('' || event_id), least(20000, 2000 * (event_id % 20)) FROM events")
def s11c(spark, d):
    """Entries put to the history; an output of over 20,000 characters is kept up to there, its fingerprint is the whole's."""
    events = table(spark, d, "events")
    new = events.select((-F.col("event_id") - 1).alias("id"), F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("ts"), F.col("event_type").alias("style"), F.repeat(F.lit("ab"), (F.col("event_id") % 20 * 1000).cast("int")).alias("output"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("output_key"), F.lit(0.0).alias("score"))
    return state.appended(history(spark, d), new).select("id", "ts", "style", "output_key", F.length("output").cast("long").alias("n_chars"))


@query("J09_M04_provenance", "SELECT d.id AS doc_id, h.id AS entry FROM (SELECT id, output_key FROM hist) d JOIN (SELECT output_key, arg_max(id, ts * 1000000000 + id) AS id FROM hist GROUP BY output_key) h USING (output_key)")
def j09(spark, d):
    h = history(spark, d)
    return state.generated(h.select(F.col("id").alias("doc_id"), F.col("output").alias("text")), h)


@query("A25_S13_usage", "SELECT user_id, ts::DATE AS usage_date, count(*) * 100 AS words, count(*) * 100 + 100 <= 1000 AS allowed FROM events GROUP BY user_id, ts::DATE")
def a25(spark, d):
    requests = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.lit(100).cast("long").alias("words"))
    return state.quota(state.usage_by_day(requests), 100).withColumnRenamed("key", "user_id")


@query("W08_window_hits", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS hits, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) <= 3 AS within FROM events")
def w08(spark, d):
    return state.hits_in_window(table(spark, d, "events"), "user_id", 86400, 3).select("event_id", "hits", "within")


@query("W08_rate_limit")
def w08b(spark, d):
    """The exact limiter, a recurrence; the tests hold it against a plain loop."""
    return state.rate_limited(table(spark, d, "events"), "user_id", 86400, 3)


@query("M17_plan_gate", "SELECT plan, words_today, requested, deep, (plan = 'pro' OR words_today + requested <= 1000) AND (plan = 'pro' OR NOT deep) AS allowed FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'free' ELSE 'pro' END AS plan, (user_id % 15 * 100)::BIGINT AS words_today, 100 AS requested, user_id % 3 = 0 AS deep FROM events)")
def m17(spark, d):
    u = F.col("user_id")
    requests = table(spark, d, "events").select(F.when(u % 2 == 0, "free").otherwise("pro").alias("plan"), (u % 15 * 100).alias("words_today"), F.lit(100).alias("requested"), (u % 3 == 0).alias("deep"))
    return state.plan_allows(requests, spark).select("plan", "words_today", "requested", "deep", "allowed")


@query("S15_batch_seeds", "SELECT doc_id, 7 + row_number() OVER (ORDER BY doc_id) - 1 AS seed FROM documents")
def s15(spark, d):
    """A seed by place in the batch, numbered within ranges of ids and shifted by the sizes of the ranges before."""
    docs = table(spark, d, "documents").select("doc_id").repartitionByRange("doc_id").withColumn("p", F.spark_partition_id())
    within = docs.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("doc_id")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = docs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", before.alias("shift"))
    return within.join(F.broadcast(shift), "p").select("doc_id", (F.col("rn") + F.col("shift") + 6).alias("seed"))


# Sources and sinks


@query("S01_sniff", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'docx' END AS fmt FROM pages")
def s01(spark, d):
    kind = F.col("page_id") % 4
    name = F.when(kind == 0, "upload").when(kind == 1, "A.DOCX").when(kind == 2, "notes.md").otherwise("upload.bin")
    content = F.when(kind == 0, F.encode(F.concat(F.lit("%PDF-1.4 "), "url"), "UTF-8")).when(kind == 3, F.concat(F.unhex(F.lit("504B0304")), F.encode("url", "UTF-8"))).otherwise(F.encode("url", "UTF-8"))
    return table(spark, d, "pages").select("page_id", files.sniffed(name, content).alias("fmt"))


@query("S07_content_type", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/plain; charset=utf-8' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS type FROM pages")
def s07(spark, d):
    fmt = F.get(F.array(*map(F.lit, ("txt", "docx", "pdf", "odd"))), (F.col("page_id") % 4).cast("int"))
    return table(spark, d, "pages").select("page_id", files.content_type(fmt).alias("type"))


@query("S02_to_S06_round_trip", "SELECT doc_id, regexp_replace(" + S.trim("text") + ", '[^\\x20-\\x7e\\n]', '?', 'g') AS text, CASE doc_id % 2 WHEN 0 THEN 'txt' ELSE 'docx' END AS fmt FROM documents")
def s02(spark, d):
    """Export to files' bytes and extraction from them give the text again."""
    plain = F.regexp_replace(T.trimmed(F.col("text")), r"[^\x20-\x7e\n]", "?")
    rows = table(spark, d, "documents").select("doc_id", plain.alias("t"), F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("docx").alias("fmt"))
    return rows.select("doc_id", files.extracted(files.exported(F.col("t"), F.col("fmt")), F.col("fmt")).alias("x")).select("doc_id", "x.text", "x.fmt")


@query("S05_pdf_round_trip")
def s05(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.lit("pdf").alias("fmt"))
    return rows.select("doc_id", files.extracted(files.exported(F.col("text"), F.col("fmt")), F.col("fmt")).alias("x")).select("doc_id", "x.text", "x.error")


@query("S08_paragraphs", f"SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text || E'\\n\\n# note\\n\\nLast.', '\\n[ \\t\\r]*\\n'), lambda p: {S.trim('p')}), lambda p: p <> '' AND NOT starts_with(p, '#'))) AS paragraph FROM documents")
def s08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(files.paragraphs(F.concat("text", F.lit("\n\n# note\n\nLast.")))).alias("paragraph"))


@query("S09_json_bodies", "SELECT event_id, CASE WHEN strlen(props) > 2097152 THEN 413 WHEN props IS NULL OR NOT starts_with(trim(props), '{') OR NOT json_valid(props) THEN 400 ELSE 200 END AS status FROM events")
def s09(spark, d):
    return files.json_bodies(table(spark, d, "events"), "props", "map<string,string>").select("event_id", "status")


@query("doc_rhythm", f"SELECT doc_id, n_sentences, n_words, round(cv, 6) AS cv, round(burstiness, 6) AS burstiness, round(ttr, 6) AS ttr FROM (SELECT doc_id, len(s) AS n_sentences, len(w) AS n_words, CASE WHEN len(l) < 2 THEN 0 ELSE coalesce(list_stddev_samp(l) / nullif(list_avg(l), 0), 0) END AS cv, len(list_distinct(w))::DOUBLE / nullif(len(w), 0) AS ttr FROM (SELECT doc_id, s, l, {S.words('text')} AS w FROM len JOIN drafts USING (doc_id))) JOIN burst USING (doc_id)")
def doc_rhythm(spark, d):
    rows = sents(spark, d)
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"), rounded(signals.length_stats(F.col("s"))[1]).alias("cv"), rounded(signals.burstiness(F.col("s"))).alias("burstiness"), rounded(signals.type_token_ratio(F.col("text"))).alias("ttr"))
