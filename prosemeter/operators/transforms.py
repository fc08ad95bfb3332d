"""The deterministic rewrite, stage by stage; each stage is a function of a text column.

Replacements that keep the case of the first letter are made by one alternation for each table, longest phrase first.
Random stages take their numbers from a hash of the row's key, the seed and the place, so reruns agree whatever the
partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import let, sentences, spaced
from . import issues, rhythm, signals


def strip_marks(text: Column) -> Column:
    return F.translate(text, lexicon.MARKS, "")


def _case_like(model: str, word: str) -> str:
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def swapper(table: dict[str, str]) -> Callable[[str], str]:
    """Replaces all whole phrases of a table, longest first, keeping a capital at the head; deletions tidy up."""
    pattern = re.compile(rf"\b{lexicon.trie(list(table))}\b", re.IGNORECASE)
    deletes = any(not v for v in table.values())

    def once(text: str) -> str:
        out, done = [], 0
        for m in pattern.finditer(text):
            new = table[m[0].lower()]
            out.append(text[done : m.start()])
            done = m.end()
            if new:
                out.append(_case_like(m[0], new))
            elif m[0][:1].isupper():
                rest = text[done:].lstrip(" ,")
                done = len(text) - len(rest)
                if rest:
                    out.append(rest[0].upper())
                    done += 1
        text = "".join([*out, text[done:]])
        if deletes:
            text = re.sub(r" +([.,;:!?])", r"\1", re.sub(r"\(\s*\)", "", re.sub(r"  +", " ", text)))
        return text

    return once


def _mapped(text: Column, *tables: dict[str, str]) -> Column:
    """The tables' swaps one after another."""

    def run(texts: pd.Series) -> pd.Series:
        for table in tables:
            texts = texts.map(swapper(table), na_action="ignore")
        return texts

    return F.pandas_udf(run, "string")(text)


def phrase_swaps(text: Column) -> Column:
    return _mapped(text, lexicon.PHRASE_SWAPS)


def plain_register(text: Column) -> Column:
    """A chain of two entries is followed: what leads to another entry is replaced in a first pass."""
    return _mapped(text, {k: v for k, v in lexicon.PLAIN_SWAPS.items() if v in lexicon.PLAIN_SWAPS}, lexicon.PLAIN_SWAPS)


def conditional_transitions(text: Column) -> Column:
    """"in turn" and "as such" go at the start, after a comma or "and"; "moving forward" unless a comma follows."""
    t = F.regexp_replace(text, r"(^|, |\band )(?:in turn|as such),? ", "$1")
    return F.regexp_replace(t, r" moving forward(?!,)", "")


def transition_openers(text: Column) -> Column:
    """The first alternative for a transition that begins a sentence, capitalised; one search for all of them."""
    table = {k.capitalize(): v.capitalize() for k, v in lexicon.TRANSITION_SWAPS.items()}
    return _at_once(text, rf"(?:^|(?<=[.!?] )){lexicon.trie(list(table))}\b", table)


def word_swaps(text: Column) -> Column:
    """Whole tokens, hyphens included, all found by one search; a capital at the head is kept, other capitals are not met.

    No word of the table is another's replacement, so one pass does what a pass for each word would do.
    """
    table = {form(k): form(v) for k, v in lexicon.WORD_SWAPS.items() for form in (str, str.capitalize)}
    return _at_once(text, rf"(?<![A-Za-z0-9_-]){lexicon.trie(list(table))}(?![A-Za-z0-9_-])", table)


def _at_once(text: Column, pattern: str, table: dict[str, str]) -> Column:
    """Each match of a pattern, all of which are keys of the table, replaced; a text without any is not split."""
    others = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(text.rlike(pattern), _changed(text, pattern, lambda m, _: F.element_at(others, m))).otherwise(text)


def _changed(text: Column, pattern: str, change: Callable[[Column, Column], Column]) -> Column:
    """A text with each match changed, by the match and its place among them; what stands around is kept."""
    changed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern), changed, lambda part, m: F.array(part, F.coalesce(m, F.lit(""))))), "")


def capitalised(text: Column) -> Column:
    """Each sentence with a capital; what stands between sentences becomes one space."""
    return F.array_join(F.transform(sentences(text), _capital), " ")


def both_and(text: Column) -> Column:
    """The first "not only A but (also) B" of each sentence becomes "both A and B"."""
    return F.array_join(F.transform(sentences(text), lambda s: F.regexp_replace(s, r"^((?s:.*?))\bnot only ([^,.;]+?),? but (?:also )?", "$1both $2 and ")), " ")


def dehedged(text: Column) -> Column:
    """The first hit of each hedge goes."""
    t = text
    for hedge in (r"\bit could be argued that ", r"\bperhaps ", r"\bgenerally speaking,? "):
        t = F.regexp_replace(t, rf"^((?s:.*?)){hedge}", "$1")
    return t


def without_dashes(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*—\s*", ", ")


def finished(text: Column) -> Column:
    """Sentences joined by one space, with a full stop if nothing ends the text."""
    ended = lambda j: F.when((j == "") | j.rlike(r"""[.!?]["')]?$"""), j).otherwise(F.concat(j, F.lit(".")))
    return let(F.array_join(sentences(text), " "), ended)


def chance(key: Column, seed: int, stage: str, place: Column) -> Column:
    """A number from 0 to 1 for a row, a stage and a place in the text."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(stage), place), F.lit(10000)) / 10000.0


def varied_openers(key: Column, text: Column, intensity: float, seed: int = 0) -> Column:
    """From three sentences on: a transition before a comma becomes one of its alternatives, drawn by hash; of other
    sentences that begin with a hedge, the hedge goes with a chance of .3 + .8 * intensity."""
    transition = rf"^(?i:({'|'.join(lexicon.OPENER_CHOICES)}))(?=\s*,)"
    hedge = rf"^(?i:(?:{'|'.join(lexicon.START_HEDGES)})),?\s+"
    choices = F.create_map(*[x for word, others in lexicon.OPENER_CHOICES.items() for x in (F.lit(word), F.array(*map(F.lit, others)))])

    def other(x: Column, i: Column) -> Column:
        options = F.element_at(choices, F.lower(F.regexp_extract(x, transition, 1)))
        pick = F.get(options, F.pmod(F.xxhash64(key, F.lit(seed), F.lit("transition"), i), F.size(options)).cast("int"))
        return F.concat(_capital(pick), F.regexp_replace(x, transition, ""))

    def of(x: Column, i: Column) -> Column:
        dropped = chance(key, seed, "open", i) < 0.3 + 0.8 * intensity
        return F.when(x.rlike(transition), other(x, i)).when(x.rlike(hedge) & dropped, _capital(F.regexp_replace(x, hedge, ""))).otherwise(x)

    return let(sentences(text), lambda s: F.when(F.size(s) < 3, text).otherwise(F.array_join(F.transform(s, of), " ")))


#: Letters whose upper() has several characters, as SS for ß, and those that only Unicode 16 has capitals for; SQL's
#: upper() gives one character for one: ẞ, a Greek letter's title form, or the letter itself.
_CAPITALS = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
_CAPITALS |= {chr(i): chr(i) for i in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))}


def _capital(x: Column) -> Column:
    """x with a capital of one character at its head."""
    head = F.left(x, F.lit(1))
    own = F.element_at(F.create_map(*[F.lit(c) for pair in _CAPITALS.items() for c in pair]), head)
    return F.concat(F.when(head < "\x80", F.upper(head)).otherwise(F.coalesce(own, F.upper(head))), F.substring(x, 2, 1 << 30))


def _by_hits(key: Column, text: Column, table: dict[str, list[str]], p: float, seed: int, stage: str) -> Column:
    """Each hit of a phrase of the table, whatever its case, becomes one of its alternatives with chance p; a capital at
    its head is kept, and so is what stands around it."""
    pattern = rf"(?i)\b{lexicon.trie(list(table))}\b"
    choices = F.create_map(*[x for word, others in table.items() for x in (F.lit(word), F.array(*map(F.lit, others)))])

    def swapped(m: Column, i: Column) -> Column:
        options = F.element_at(choices, F.lower(m))
        new = F.get(options, F.pmod(F.xxhash64(key, F.lit(seed), F.lit(stage + " choice"), i), F.size(options)).cast("int"))
        cased = F.when(F.left(m, F.lit(1)) == F.lower(F.left(m, F.lit(1))), new).otherwise(_capital(new))
        return F.when(chance(key, seed, stage, i) < p, cased).otherwise(m)

    return _changed(text, pattern, swapped)


def synonyms(key: Column, text: Column, intensity: float, seed: int = 0) -> Column:
    """From intensity .6 on, each hit with chance .25 + .35 * intensity."""
    return text if intensity < 0.6 else _by_hits(key, text, lexicon.SYNONYMS, 0.25 + 0.35 * intensity, seed, "synonym")


def contractions(key: Column, text: Column, intensity: float, seed: int = 0) -> Column:
    """From intensity .6 on, each hit of a phrase of the table with chance .25 + .35 * intensity; a capital is kept."""
    table = {k: [v] for k, v in lexicon.CONTRACTIONS.items()}
    return text if intensity < 0.6 else _by_hits(key, text, table, 0.25 + 0.35 * intensity, seed, "contract")


def asides(key: Column, text: Column, intensity: float, seed: int = 0) -> Column:
    """From intensity .75 and four sentences on: an aside before some sentences that begin safely, a third at most."""
    if intensity < 0.75:
        return text
    safe = r"^(?:The|This|It|We|They) "
    aside = lambda x: F.concat(F.lit("In short, "), F.lower(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))
    return _some(text, 3, lambda x, i: x.rlike(safe) & (chance(key, seed, "aside", i) < 0.35), aside)


def _some(text: Column, part: int, wanted: Callable[[Column, Column], Column], change: Callable[[Column], Column]) -> Column:
    """From four sentences on: the first of the wanted sentences changed, one in `part` of all at most."""

    def of(s: Column) -> Column:
        chosen = F.filter(F.transform(s, lambda x, i: F.when(wanted(x, i), i)), lambda i: i.isNotNull())
        few = F.slice(chosen, F.lit(1), F.floor(F.size(s) / part).cast("int"))
        changed = let(few, lambda f: F.transform(s, lambda x, i: F.when(F.array_contains(f, i), change(x)).otherwise(x)))
        return F.when(F.size(s) < 4, text).otherwise(F.array_join(changed, " "))

    return let(sentences(text), of)


def fronted(key: Column, text: Column, intensity: float, seed: int = 0) -> Column:
    """From intensity .75 and four sentences on: "A because B." may become "Because B, a."; a quarter at most."""
    if intensity < 0.75:
        return text
    clause = r"^([A-Z])([^,;:]+) (because|although|while|when|if) ([^,;:]+)([.!?])$"

    def turn(x: Column) -> Column:
        g = [F.regexp_extract(x, clause, i) for i in range(1, 6)]
        return F.concat(F.initcap(g[2]), F.lit(" "), g[3], F.lit(", "), F.lower(g[0]), g[1], g[4])

    return _some(text, 4, lambda x, i: x.rlike(clause) & (chance(key, seed, "front", i) <= 0.55), turn)


def _draws(key: Column, sents: Column, seed: int, stage: str) -> Column:
    return F.transform(sents, lambda _, i: chance(key, seed, stage, i))


def varied_length(key: Column, text: Column, intensity: float, min_words: int, max_words: int, seed: int = 0) -> Column:
    """From five sentences on whose lengths vary by less than .4: one over max_words is cut with chance
    .4 + .8 * intensity, and one of three to min_words joins such a one before it with chance .2 + .6 * intensity."""
    rule = rhythm.Rule((max_words + 1, 1 << 30), (3, min_words), 2 * min_words, 0.4 + 0.8 * intensity, 0.2 + 0.6 * intensity)
    s = sentences(text)
    return rhythm.restructured(text, s, _draws(key, s, seed, "length"), text.isNotNull(), rule, 5, 0.4, force=False)


def diversified(key: Column, text: Column, source: Column | None = None, intensity: float = 0.5, seed: int = 0) -> Column:
    """From four sentences on whose lengths vary by less than .30, if the source has any issue: sentences of 18 to 46
    words are cut and neighbours of 12 to 34 joined, each with chance .35 + .4 * intensity; what stays flat is forced."""
    source = text if source is None else source
    p = 0.35 + 0.4 * intensity
    rule = rhythm.Rule(rhythm.FLAT.cut, rhythm.FLAT.join, rhythm.FLAT.joined, p, p)
    s = sentences(text)
    changed = rhythm.restructured(text, s, _draws(key, s, seed, "rhythm"), text.isNotNull(), rule, 4, 0.30, force=True)
    return F.when(F.size(issues.checks(source, sentences(source))) > 0, changed).otherwise(text)


def forced_rhythm(text: Column) -> Column:
    """From four sentences on whose lengths vary by less than .30: cuts, then joins, until they vary by .30 or nothing
    is left to change; no random numbers."""
    s = sentences(text)
    never = rhythm.Rule(rhythm.FLAT.cut, rhythm.FLAT.join, rhythm.FLAT.joined, 0.0, 0.0)
    return rhythm.restructured(text, s, F.transform(s, lambda _: F.lit(1.0)), text.isNotNull(), never, 4, 0.30, force=True)


def rewrite(text: Column) -> Column:
    """All deterministic stages that need no random number, in order."""
    for stage in (strip_marks, phrase_swaps, conditional_transitions, transition_openers, word_swaps, capitalised, plain_register, both_and, dehedged, without_dashes, capitalised, finished):
        text = stage(text)
    return text
