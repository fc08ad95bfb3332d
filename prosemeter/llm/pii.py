"""Personal data: four kinds by pattern, and more of them by contexts learned from the whole corpus.

Method. What the four base patterns find are seeds. Every seed, and every loose candidate that no base pattern found (a
number of seven digits or more in any grouping, or a word with an at sign), is an instance; the words around it induce
lexical patterns: the two words before it, the word before and the word after it, the word before it, the two words
after it. Distinct pairs of pattern and instance are the edges of a graph, and it is scored in rounds:

* an instance is known as a kind if it is a seed of it or was discovered as it; what it was first known as, it stays;
* a pattern's precision for a kind is its known instances of the kind over all of its instances that could be of it
  (which their shapes tell) plus `doubt`; instances known as another kind count against it, and unknown ones as much as
  `unknown` says: a form that base patterns cannot see must not speak against a context only because it is frequent;
* a pattern of at least `support` distinct known instances and a precision of `confidence` or more discovers the unknown
  instances of its contexts whose shape suits the kind; two such patterns, or one that leaves little doubt (`sure`), are
  needed, so that one chance context does not drift;
* what was discovered are seeds of the next round, so that contexts which only they stand in induce patterns too.

Rounds go on until nothing new is discovered: known instances only become more, so that is reached; `rounds` bounds the
drift and is documented as such. Scores are whole millionths and sums of whole numbers, so they do not depend on the
order in which executors add them.

All of it is tables: edges are distinct before they are joined, sums are pre-aggregated, nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import discard, join_each, materialise, over_texts

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
# A run of digits that a failed or finished match left behind cannot begin another match, so none is entered midway.
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9][0-9().+/\x20-]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}<>"
_SPACE = " \t\n\v\f\r"


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 5 + 2 * d % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, entered at each at sign so that no run is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_BACKWARDS.fullmatch(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of what the four base patterns find, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of loose candidates that no span of found overlaps."""
    loose = []
    if "@" in text:
        for m in _WORD.finditer(text):
            word = m[0]
            if "@" not in word:
                continue
            a = m.start() + len(word) - len(word.lstrip(_EDGES))
            b = m.start() + len(word.rstrip(_EDGES))
            if b - a >= 5:
                loose.append((a, b))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            run = m[0].rstrip("().+/ -")
            if len(_DIGIT.findall(run)) >= 7:
                a = m.start()
                while a and text[a - 1] in "(+":
                    a -= 1
                loose.append((a, m.start() + len(run)))
    out, i = [], 0
    spans = [(a, b) for a, _, b in found]
    for a, b in sorted(loose):
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in spans[max(0, i - 3) : i + 4]) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


def _word(w: str) -> str:
    return _DIGIT.sub("0", w.strip(_EDGES).lower())


def _last_words(text: str, end: int, n: int) -> list[str]:
    """The last n words before a position, whole ones, however long."""
    out: list[str] = []
    while len(out) < n:
        while end and text[end - 1] in _SPACE:
            end -= 1
        if not end:
            break
        start = end
        while start and text[start - 1] not in _SPACE:
            start -= 1
        out.insert(0, text[start:end])
        end = start
    return out


def _first_words(text: str, start: int, n: int) -> list[str]:
    out = []
    while len(out) < n and (m := _WORD.search(text, start)):
        out.append(m[0])
        start = m.end()
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: its neighbouring words, lower-cased, without edges, digits as 0.

    Punctuation alone is no word. Long words stand for themselves by their hash, so that a pattern is short.
    """

    def told(words: list[str]) -> list[str]:
        words = [w for w in map(_word, words) if w]
        return [w if len(w) <= 40 else f"#{xxhash.xxh3_64_hexdigest(w)}" for w in words]

    before, after = told(_last_words(text, start, 2)), told(_first_words(text, end, 2))
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if before:
        out.append(f"{before[-1]} _")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return out


def suits(value: str) -> int:
    """The kinds that a candidate may be discovered as, a bit for each as in KINDS, by its shape."""
    digits, at = len(_DIGIT.findall(value)), "@" in value
    each = (at, not at and digits <= 12 and value.count(".") >= 3, not at and 12 <= digits <= 19, not at and 7 <= digits <= 15)
    return sum(1 << k for k, yes in enumerate(each) if yes)


SCANNED = "n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<start: int, end: int, kind: int, suits: int, instance: long, patterns: array<string>>>"


def _scan(raw: bytes | None) -> dict:
    text = "" if raw is None else raw.decode("utf-8", "replace")
    base = base_spans(text)
    found = []
    for a, k, b in base + [(a, -1, b) for a, b in candidates(text, base)]:
        value = text[a:b]
        found.append({"start": a, "end": b, "kind": k, "suits": suits(value) if k < 0 else 1 << k, "instance": xxhash.xxh3_64_intdigest(value.lower()) - 2**63, "patterns": contexts(text, a, b)})
    n = [sum(k == i for _, k, _ in base) for i in range(4)]
    return {**{f"n_{x}": n[i] for i, x in enumerate(KINDS)}, "base": ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base), "found": found}


def scanned_column(text: Column) -> Column:
    """A column of struct SCANNED for a column of texts."""
    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("suits", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
    kind = pa.struct([*((f"n_{x}", pa.int64()) for x in KINDS), ("base", pa.string()), ("found", pa.list_(one))])
    return over_texts(lambda texts: pa.array([_scan(t) for t in texts], kind), SCANNED)(text)


def edges_of(scanned: DataFrame) -> DataFrame:
    """(pattern, instance, kind, suits, rows), each pair once; scanned: a table with column s.

    kind is -1 for no seed; rows counts how often the pair stands in the texts.
    """
    seen = scanned.where("size(s.found) > 0").select(F.explode("s.found").alias("f"))
    each = seen.select(F.explode("f.patterns").alias("pattern"), F.col("f.instance").alias("instance"), F.col("f.kind").alias("kind"), F.col("f.suits").alias("suits"))
    return each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bit_or("suits").alias("suits"), F.count(F.lit(1)).alias("rows"))


def _able(suits_: str, kind: str) -> Column:
    return F.expr(f"({suits_} & shiftleft(1, {kind})) > 0")


def trusted(told: DataFrame, confidence: float = 0.5, support: int = 3, doubt: int = 1, unknown: float = 0.1) -> DataFrame:
    """(pattern, good, n) of the high-confidence patterns; good: an array of (kind, score), n: its instances.

    told: (pattern, instance, suits, kind) of each edge, kind null for what is not known.
    """
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"c{k}") for k in range(4)]
    loose = [F.count(F.when(F.col("kind").isNull() & (F.col("suits").bitwiseAND(1 << k) > 0), 1)).alias(f"u{k}") for k in range(4)]
    summed = told.groupBy("pattern").agg(*counts, *loose, F.count("kind").alias("c"), F.count(F.lit(1)).alias("n"))
    score = [F.floor(F.col(f"c{k}") * 1000000 / (F.col("c") + doubt + F.lit(unknown) * F.col(f"u{k}"))) for k in range(4)]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), score[k].alias("score"), F.col(f"c{k}").alias("c")) for k in range(4)])
    good = F.filter(each, lambda x: (x["score"] >= round(confidence * 1000000)) & (x["c"] >= support))
    return summed.select("pattern", F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), x["score"].alias("score"))).alias("good"), "n").where("size(good) > 0")


def bootstrapped(edges: DataFrame, rounds: int = 12, sure: float = 0.7, **trust) -> tuple[DataFrame, DataFrame]:
    """Known instances (instance, kind), seeds included, and the patterns that are trusted then, as of `trusted`.

    edges: as of `edges_of`, materialised; an instance is one of them however many texts repeat it. Ends when a round
    adds none, or after `rounds` rounds. Of two kinds, an instance takes the one of the better best pattern, and the
    first in KINDS of equal ones. trust: arguments of `trusted`.
    """
    known = materialise(edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind")), "pii-known")
    # A pattern without a candidate that suits a kind discovers nothing, and one of few instances never will.
    loose = F.count(F.when((F.col("kind") < 0) & (F.col("suits") > 0), 1))
    open_ = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), loose.alias("loose")).where((F.col("n") >= trust.get("support", 3)) & (F.col("loose") > 0))
    usable = materialise(edges.select("pattern", "instance", "suits").join(open_.select("pattern"), "pattern"), "pii-edges")
    n_edges, n_known = usable.count(), known.count()
    for _ in range(rounds):
        told = materialise(usable.join(known, "instance", "left"), "pii-told")
        met = join_each(told.where("kind IS NULL").select("pattern", "instance", "suits"), trusted(told, **trust), ["pattern"], "n", n_edges)
        met = met.select("instance", "suits", F.explode("good").alias("g")).where(_able("suits", "g.kind"))
        best = met.groupBy("instance", F.col("g.kind").alias("kind")).agg(F.max("g.score").alias("score"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("score") >= round(sure * 1000000)))
        new = best.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("m")).select("instance", (-F.col("m.col2")).cast("int").alias("kind"))
        known, old = materialise(known.union(new), "pii-known"), known
        discard(old, told)
        n_before, n_known = n_known, known.count()
        if n_known == n_before:
            break
    good = materialise(trusted(usable.join(known, "instance", "left"), **trust), "pii-patterns")
    discard(usable)
    return known, good


def find(docs: DataFrame, carry: list[str], text_col: str = "text", **learning) -> DataFrame:
    """For each row of docs: struct row of the columns in carry, the base counts, base and spans.

    base and spans are kind:start:end, joined by commas in the order of start, then kind as in KINDS; positions are
    code points, ends are exclusive. spans holds the base spans and the discovered ones. A null text counts as empty:
    counts of 0 and empty strings. Repeated rows count as often as they stand, but as one instance in the graph; rows
    of null or equal ids are rows like any other. A text of any length is read whole. An empty table gives an empty
    result; no column of docs but those named is looked at, and none can clash. learning: arguments of `bootstrapped`.
    """
    row = F.struct(*[F.col(c) for c in carry])
    scanned = materialise(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("uid"), scanned_column(F.col(text_col)).alias("s")), "pii-scan")
    edges = materialise(edges_of(scanned), "pii-graph")
    known, good = bootstrapped(edges, **learning)
    # What is known stands out where a trusted pattern of its kind is around it, not everywhere.
    fresh = edges.where("kind < 0").select("pattern", "instance", "rows").join(known, "instance").join(good.drop("n"), "pattern")
    fresh = materialise(fresh.where(F.exists("good", lambda g: g["kind"] == F.col("kind"))).select("pattern", "instance", "kind", "rows"), "pii-fresh")
    loose = scanned.where(F.exists("s.found", lambda f: f["kind"] < 0)).select("uid", F.explode("s.found").alias("f")).where("f.kind < 0")
    loose = loose.select("uid", "f.start", "f.end", "f.instance", F.explode("f.patterns").alias("pattern"))
    total = edges.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    added = join_each(loose, fresh, ["pattern", "instance"], "rows", total).select("uid", F.struct("start", "kind", "end").alias("a")).groupBy("uid").agg(F.collect_set("a").alias("added"))
    base = F.transform(F.filter("s.found", lambda f: f["kind"] >= 0), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))
    all_ = F.array_sort(F.concat(base, F.transform("added", lambda f: F.struct(f["start"].alias("start"), f["kind"].cast("int").alias("kind"), f["end"].alias("end")))))
    named = F.array(*map(F.lit, KINDS))
    joined = F.array_join(F.transform(all_, lambda f: F.concat_ws(":", F.get(named, f["kind"]), f["start"], f["end"])), ",")
    out = scanned.join(added, "uid", "left")
    return out.select("row", *[F.col(f"s.n_{k}").alias(f"n_{k}") for k in KINDS], F.col("s.base").alias("base"), F.when(F.col("added").isNull(), F.col("s.base")).otherwise(joined).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The texts with each span replaced by its kind in capitals between brackets; overlapping spans are one."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in columns:
            out = []
            for raw, told in zip(texts, lists, strict=True):
                raw, told = raw.as_py(), told.as_py()
                if raw is not None and told:
                    raw = _without(raw, told)
                out.append(raw)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(text, spans)


def _without(text: str, spans: str) -> str:
    parts, done = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",")):
        a, b = int(a), int(b)
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])
