"""Lookup tables of the engine, small enough to be literals or broadcast dimension tables.

Phrases are written with their variants: ``utili{z,s}{e,es,ed,ing}`` stands for eight phrases, ``{a,} few`` for two.
What is long is built from such rules.
"""

from __future__ import annotations

import re
from itertools import product


def variants(rule: str) -> list[str]:
    """The phrases that a rule stands for, in order, each once; spaces left by empty alternatives are closed up."""
    parts = [p.split(",") if i % 2 else [p] for i, p in enumerate(re.split(r"[{}]", rule))]
    return list(dict.fromkeys(" ".join("".join(p).split()) for p in product(*parts)))


#: By kind: rules of phrases, and after the colon what to write instead. Severity is derived: high for several words,
#: medium for one; a rule under ``low`` is low.
_TRANSITIONS = """
furthermore: also
moreover: besides
additionally: also
in addition to {this,that,these}: also
in conclusion: end with the point
in summary: give the point
to {summarise,summarize,conclude}: give the point
all things considered: give the judgement
{with,having} that {said,in mind}: go on
that being said: but
on the one hand: compare directly
by the same token: likewise
last but not least: and
first and foremost: first
as {previously,already} {mentioned,noted,stated}: leave out
as a {direct,natural} consequence: so
in light of {this,these,the above}: so
building on this: next
it follows that: so
{equally,just as} important{,ly}: and
to {begin,start} with: first
by way of contrast: but
for all intents and purposes: in effect
in the same vein: likewise
{conversely,correspondingly}: but
in essence: leave out
"""
_CLICHES = """
in today's {world,fast-paced world,digital age,modern era}: say when
in {an,this} {increasingly,ever more} {connected,complex,digital} world: say what changed
{ever,constantly,rapidly}-{evolving,changing,shifting} {landscape,world,environment}: name the change
{rich,vibrant,intricate} tapestry: name the parts
game{-, }chang{er,ers,ing}: say what changed
cutting{-, }edge: new
{push,pushes,pushing} the boundaries: say what is new
{tip,tips} of the iceberg: say how much more
{double,two}-edged sword: name both effects
{paradigm,seismic} shift: name the change
{perfect,gathering} storm: name the causes
low{-, }hanging fruit: the easy part
{level,raise} the {playing field,bar}: say how
think outside the box: name the idea
{move,moves,moved} the needle: give the figure
{at,to} the {heart,core} of {this,the matter}: say what matters
stand the test of time: last
a {breath of fresh air,beacon of hope,force to be reckoned with}: describe it
{treasure trove,wealth} of {information,knowledge,insights}: say how much
{endless,limitless,boundless} {possibilities,opportunities,potential}: name some
{uncharted,unexplored} {territory,waters}: say what is unknown
{pave,paves,paved,paving} the way: make possible
{unlock,unlocks,unlocking} the {power,potential,secrets}: use
{harness,harnesses,harnessing} the power: use
{embark,embarks,embarked} on a journey: start
{stark,timely,sobering} reminder: say what it shows
{bridge,bridges,bridging} the gap: join
{strike,strikes,striking} a {balance,chord}: weigh
{navigate,navigating} the {complexities,challenges}: deal with
{spark,sparks,sparked} a {conversation,debate}: start a debate
{well-oiled,finely tuned} machine: say how it works
{bustling,sprawling} metropolis: city
{hustle and bustle,ebb and flow}: describe it
"""
_FILLERS = """
it is {important,crucial,essential} to {note,remember,mention,recognise} that: leave out
it is worth {noting,mentioning,remembering} that: leave out
it {should,must} be {noted,stressed,emphasised} that: leave out
needless to say: leave out
it goes without saying: leave out
at the end of the day: in the end
when all is said and done: in the end
{in,with} {regard,respect} to: about
due to the fact that: because
in spite of the fact that: although
the fact of the matter: say it
{for,with} the purpose of: for
in the process of: while
a {large,vast,significant} {number,amount,majority} of: many
{each and every,first and only}: each
{basic,true} fundamentals: basics
{completely,totally} {unique,unanimous}: leave out the adverb
{absolutely,very} {essential,critical}: necessary
in {close,the near} proximity to: near
at this point in time: now
{until,till} such time as: until
{on,during} a {daily,regular} basis: daily
{as,because} of the fact that: because
the {reason,question} as to why: why
take into {consideration,account} the fact: consider
with the {exception,possible exception} of: but for
{has,have} the ability to: can
{is,are} in a position to: can
{make,makes,made} use of: use
{what it comes down to is,the thing is that}: leave out
{as a matter of fact,in actual fact}: in fact
"""
_FORMULAS = """
{play,plays,played,playing} a {crucial,vital,pivotal,key,significant,central} role: say what it does
{serve,serves,served} as a {testament,reminder,catalyst,cornerstone}: show
{stand,stands} as a {testament,symbol,monument}: show
a {wide,broad,diverse} {range,array,variety,spectrum} of: many
utili{z,s}{e,es,ed,ing}: use
leverag{e,es,ed,ing}: use
facilitat{e,es,ed,ing}: help
underscor{e,es,ed,ing}: show
showcas{e,es,ed,ing}: show
streamlin{e,es,ed,ing}: simplify
spearhead{,s,ed,ing}: lead
bolster{,s,ed,ing}: support
foster{,s,ed,ing}: encourage
delv{e,es,ed,ing} {into,deeper into}: look at
{dive,dives,diving} {deep,deeper} into: look at
shed{,s,ding} light on: explain
robust: strong
seamless{,ly}: smooth
holistic{,ally}: whole
multifaceted: varied
transformative: say what it changes
groundbreaking: new
unparalleled: say compared to what
meticulous{,ly}: careful
synerg{y,ies,istic}: say what works together
{profound,lasting,significant} {impact,implications} on: say which
{deep,deeper,nuanced} understanding of: say what is known
{myriad,plethora} of: many
{key,valuable,actionable} {takeaways,insights}: say what was learned
{best-in-class,world-class,state-of-the-art}: say how good
{comprehensive,in-depth} {overview,guide,exploration}: overview
{whether you are,whether you're} a: say for whom
{from,ranging from} {small,humble} beginnings: say where it began
{ongoing,continuous} {commitment,dedication} to: say what is done
the {importance,significance} of this cannot be overstated: say why it matters
{not just,not merely} {about,a matter of}: say what it is
{raises,raising} {important,serious,critical} questions: ask them
{empower,empowers,empowering} {individuals,users,people,teams}: let
"""
_HEDGES = """
it {could,can,might,may} be {argued,said}: argue it
generally speaking: mostly
{broadly,relatively,comparatively} speaking: say how much
to {some,a certain} {extent,degree}: say how much
in {many,most} {cases,respects}: say in which
it {seems,appears} {likely,possible} that: say how likely
there is {reason,evidence} to {believe,suggest}: give it
more or less: leave out
{arguably,conceivably}: argue it
{presumably,supposedly}: say who says so
one {might,could} {say,argue,wonder}: say it
as far as {anyone,one} can tell: say how it is known
for the most part: mostly
under {certain,some} circumstances: say which
it is {possible,conceivable} that: may
{tend,tends} to {suggest,indicate}: show
"""
_LOW = {
    "transition": "consequently: so\nnevertheless: still\nnonetheless: still\naccordingly: so\nsubsequently: then\nnotwithstanding: despite",
    "cliche": "needle in a haystack: say how rare\nbest of both worlds: name both",
    "filler": "in order to: to\nin terms of: in\nwhether or not: whether\nas well as: and",
    "formulaic": "not only: both\n{either,neither} way: say which",
    "hedge": "perhaps: say it or leave it\nsomewhat: say how much\nto be honest: leave out",
}


def _told() -> list[tuple[str, list[str], str, str, str | None]]:
    kinds = {"transition": _TRANSITIONS, "cliche": _CLICHES, "filler": _FILLERS, "formulaic": _FORMULAS, "hedge": _HEDGES}
    rules = [(kind, None, line) for kind, text in kinds.items() for line in text.strip().split("\n")]
    rules += [(kind, "low", line) for kind, text in _LOW.items() for line in text.split("\n")]
    out = []
    for kind, severity, line in rules:
        rule, advice = line.split(": ")
        phrases = variants(rule)
        out.append((phrases[0], phrases, advice, kind, severity))
    return out


#: (label, phrases, suggestion, kind, severity or null) of each tell; the label is its first phrase.
TELLS: list[tuple[str, list[str], str, str, str | None]] = _told()


def trie(phrases: list[str]) -> str:
    """A regular expression for any of the phrases; those with a common beginning share it, the longest wins."""

    def branch(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for p in rest:
            heads.setdefault(p[:1], []).append(p[1:])
        parts = [h + branch(tails) if h else "" for h, tails in sorted(heads.items(), reverse=True)]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(sorted(set(phrases)))


def tell_pattern(phrases: list[str]) -> str:
    """A tell's matches on lowered text; its phrases hold letters, spaces, hyphens and apostrophes only."""
    return rf"\b{trie(phrases)}\b"


#: Any tell, on lowered text.
ANY_TELL = tell_pattern([p for t in TELLS for p in t[1]])

#: Words that say little by themselves.
STOPWORDS = "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its just like may me more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your".split()

COMMON_OPENERS = "the this that these it there we they he she in as a and".split()

#: Numbering adverbs, made of ordinals, and those that close a list.
LIST_MARKERS = [f"{x}ly" for x in "first second third fourth fifth last final".split()]

#: Nominal suffixes of abstract nouns, those from Latin and those from Old English.
ABSTRACT_ENDINGS = [*(f"{x}ion" for x in "tsx"), *(f"{x}nce" for x in "ae"), *(f"{x}ncy" for x in "ae"), "acy", "ity", "ism", "ment", "ure", "ness", "ship", "hood", "dom"]

#: Fixed values of the Unicode standard: code point, name, whether it can reorder what is shown.
INVISIBLE: list[tuple[int, str, bool]] = [
    (0x00AD, "soft hyphen", False),
    (0x034F, "combining grapheme joiner", False),
    (0x061C, "arabic letter mark", True),
    (0x115F, "hangul choseong filler", False),
    (0x1160, "hangul jungseong filler", False),
    (0x180E, "mongolian vowel separator", False),
    (0x200B, "zero width space", False),
    (0x200C, "zero width non-joiner", False),
    (0x200D, "zero width joiner", False),
    (0x200E, "left-to-right mark", False),
    (0x200F, "right-to-left mark", False),
    (0x202A, "left-to-right embedding", True),
    (0x202B, "right-to-left embedding", True),
    (0x202C, "pop directional formatting", True),
    (0x202D, "left-to-right override", True),
    (0x202E, "right-to-left override", True),
    (0x2060, "word joiner", False),
    (0x2061, "function application", False),
    (0x2062, "invisible times", False),
    (0x2063, "invisible separator", False),
    (0x2066, "left-to-right isolate", True),
    (0x2067, "right-to-left isolate", True),
    (0x2068, "first strong isolate", True),
    (0x2069, "pop directional isolate", True),
    (0xFEFF, "byte order mark", False),
]
MARKS = "".join(chr(c) for c, _, _ in INVISIBLE)
DANGEROUS_MARKS = "".join(chr(c) for c, _, d in INVISIBLE if d)

NEGATIONS = "no not never none nobody nothing neither nor cannot without".split()

#: Capitalised words that name nothing.
NON_ENTITIES = "The This That These Those It There We They He She In On At As And But Or If When While For From With By To Of A An".split()


def _swaps(text: str) -> dict[str, str]:
    """Lines "rule: other"; the other's variants go with the rule's if it has as many, else all go to its first."""
    out: dict[str, str] = {}
    for line in text.strip().split("\n"):
        rule, other = line.split(":")
        a, b = variants(rule), variants(other.strip())
        out |= {x: b[i] if len(a) == len(b) else b[0] for i, x in enumerate(a)}
    return out


#: Swaps of the deterministic rewrite. Longest first is the order of application; "" deletes.
PHRASE_SWAPS = _swaps("""
it is {important,crucial,essential} to {note,remember,mention,recognise} that:
it is worth {noting,mentioning,remembering} that:
it {should,must} be {noted,stressed,emphasised} that:
needless to say:
it goes without saying that:
at the end of the day: in the end
when all is said and done: in the end
in order to: to
so as to: to
for the purpose of: for
due to the fact that: because
in view of the fact that: because
in spite of the fact that: although
a {wide,broad,diverse} {range,array,variety,spectrum} of: many
a {large,vast,significant} {number,majority} of: many
a {vast,significant} amount of: much
at this point in time: now
in the near future: soon
in the event that: if
until such time as: until
on a {daily,weekly,monthly} basis: {daily,weekly,monthly}
{has,have} the ability to: can
{is,are} able to: can
{delve,delves,delved} into: {look,looks,looked} at
{shed,sheds} light on: {explain,explains}
{make,makes,made} use of: {use,uses,used}
{take,takes,took} into account: {weigh,weighs,weighed}
{come,comes,came} to the conclusion that: {conclude,concludes,concluded} that
{give,gives,gave} rise to: {cause,causes,caused}
{put,puts} an end to: {end,ends}
with {regard,respect} to: about
in {close,the near} proximity to: near
in the absence of: without
with the exception of: but for
the vast majority of: most
each and every: each
first and foremost: first
last but not least: last
""")
TRANSITION_SWAPS = {"furthermore": "also", "moreover": "besides", "additionally": "also", "consequently": "so", "nevertheless": "still", "nonetheless": "still", "accordingly": "so", "subsequently": "then", "conversely": "but", "similarly": "likewise", "thus": "so", "hence": "so", "therefore": "so", "ultimately": "in the end", "notably": "above all"}
#: What a transition before a comma may become; one is drawn.
OPENER_CHOICES = {
    "furthermore": ["also", "what is more"],
    "moreover": ["besides", "on top of that"],
    "additionally": ["also", "as well as that"],
    "consequently": ["so", "as a result"],
    "nevertheless": ["still", "even so"],
    "nonetheless": ["still", "all the same"],
    "accordingly": ["so", "for that reason"],
    "subsequently": ["then", "later"],
    "conversely": ["by contrast", "the other way round"],
    "similarly": ["likewise", "in the same way"],
    "thus": ["so", "in this way"],
    "hence": ["so", "for this reason"],
    "therefore": ["so", "that is why"],
}
#: The hedges that may go from the start of a sentence.
START_HEDGES = ["notably", "importantly", "essentially", "ultimately", "overall", "arguably"]
WORD_SWAPS = _swaps("""
utiliz{e,es,ed,ing}: us{e,es,ed,ing}
leverag{e,es,ed,ing}: us{e,es,ed,ing}
facilitat{e,es,ed,ing}: {help,helps,helped,helping}
commenc{e,es,ed,ing}: {start,starts,started,starting}
demonstrat{e,es,ed,ing}: {show,shows,showed,showing}
underscor{e,es,ed,ing}: {stress,stresses,stressed,stressing}
showcas{e,es,ed,ing}: {show,shows,showed,showing}
streamlin{e,es,ed,ing}: {simplify,simplifies,simplified,simplifying}
enhanc{e,es,ed,ing}: improv{e,es,ed,ing}
necessitat{e,es,ed,ing}: {need,needs,needed,needing}
foster{,s,ed,ing}: {encourage,encourages,encouraged,encouraging}
bolster{,s,ed,ing}: {support,supports,supported,supporting}
spearhead{,s,ed,ing}: {lead,leads,led,leading}
garner{,s,ed,ing}: {win,wins,won,winning}
endeavor{,s,ed,ing}: {try,tries,tried,trying}
attain{,s,ed,ing}: {reach,reaches,reached,reaching}
possess{,es,ed,ing}: {have,has,had,having}
robust: strong
numerous: many
seamlessly: smoothly
seamless: smooth
pivotal: central
crucial: key
paramount: foremost
myriad: many
plethora: wealth
optimal: best
sufficient: enough
additional: more
substantial: large
prior: earlier
cutting-edge: modern
state-of-the-art: modern
world-class: first-rate
best-in-class: leading
fast-paced: quick
ever-changing: changing
game-changing: important
""")


def _plain() -> dict[str, str]:
    """Stiff words with their inflections, by rule; irregular ones by themselves."""
    verbs = {
        "ascertain": "find out", "assist": "help", "await": "wait for", "conceal": "hide", "construct": "build", "depart": "leave", "disclose": "show",
        "discontinue": "stop", "elucidate": "explain", "employ": "use", "encounter": "meet", "endure": "bear", "ensue": "follow", "evaluate": "judge",
        "exhibit": "show", "expedite": "speed up", "explicate": "explain", "forward": "send", "inform": "tell", "initiate": "start", "inquire": "ask",
        "locate": "find", "mitigate": "ease", "notify": "tell", "obtain": "get", "peruse": "read", "postpone": "put off", "procure": "get",
        "purchase": "buy", "ratify": "approve", "reside": "live", "retain": "keep", "reveal": "show", "select": "choose", "solicit": "ask for",
        "terminate": "end", "transmit": "send", "vacate": "leave", "verify": "check", "acquire": "get", "alleviate": "ease", "allocate": "set aside",
        "amend": "change", "anticipate": "expect", "augment": "add to", "consume": "use up", "designate": "name", "eliminate": "remove", "enumerate": "list", "formulate": "draw up",
    }
    past = {"find": "found", "wait": "waited", "hide": "hid", "build": "built", "leave": "left", "show": "showed", "stop": "stopped", "use": "used", "meet": "met", "bear": "bore", "follow": "followed", "judge": "judged", "speed": "sped", "send": "sent", "tell": "told", "start": "started", "ask": "asked", "ease": "eased", "get": "got", "read": "read", "put": "put", "buy": "bought", "approve": "approved", "live": "lived", "keep": "kept", "choose": "chose", "end": "ended", "check": "checked", "set": "set", "change": "changed", "expect": "expected", "add": "added", "name": "named", "remove": "removed", "list": "listed", "draw": "drew", "help": "helped", "explain": "explained"}

    def third(v: str) -> str:
        return v[:-1] + "ies" if v[-1] == "y" and v[-2] not in "aeiou" else v + "es" if v.endswith(("s", "sh", "ch", "x")) else v + "s"

    def before(v: str) -> str:
        return v[:-1] + "ied" if v[-1] == "y" and v[-2] not in "aeiou" else v + "d" if v.endswith("e") else {"transmit": "transmitted"}.get(v, v + "ed")

    out = {}
    for stiff, plain in verbs.items():
        head, *rest = plain.split(" ", 1)
        tail = f" {rest[0]}" if rest else ""
        out |= {stiff: plain, third(stiff): third(head) + tail, before(stiff): past[head] + tail}
    return out


PLAIN_SWAPS = {**_plain(), **_swaps("""
prerequisite{,s}: requirement{,s}
requirement{,s}: need{,s}
remuneration: pay
endeavour{,s}: {effort,efforts}
prior to: before
subsequent to: after
in the event that: if
in excess of: more than
in lieu of: instead of
in accordance with: by
on behalf of: for
by means of: by
by virtue of: by
for the duration of: during
in conjunction with: with
in the vicinity of: near
pertaining to: about
pursuant to: under
with reference to: about
as a means of: to
in receipt of: given
a number of: some
adjacent to: next to
regarding: about
concerning: about
whilst: while
amongst: among
upon: on
henceforth: from now on
heretofore: until now
aforementioned: this
commencement: start
assistance: help
component{,s}: part{,s}
residence{,s}: home{,s}
vehicle{,s}: car{,s}
beverage{,s}: drink{,s}
individual{,s}: {person,people}
location{,s}: place{,s}
objective{,s}: aim{,s}
methodolog{y,ies}: method{,s}
utilisation: use
inception: start
cessation: end
magnitude: size
proficiency: skill
totality: whole
equitable: fair
erroneous: wrong
expeditious: quick
feasible: possible
fundamental: basic
inadvertent: careless
initial: first
lengthy: long
minuscule: tiny
onerous: hard
prevalent: common
primary: main
principal: main
pristine: clean
requisite: needed
salient: main
superfluous: needless
tangible: real
ubiquitous: common
viable: workable
approximately: about
consequently: so
currently: now
frequently: often
immediately: at once
initially: at first
predominantly: mostly
previously: before
primarily: mainly
subsequently: later
sufficiently: enough
""")}  # fmt: skip

SYNONYMS = {
    "important": ["key", "central"],
    "show": ["display", "reveal"],
    "big": ["large", "sizeable"],
    "small": ["little", "slight"],
    "quick": ["fast", "rapid"],
    "hard": ["difficult", "tough"],
    "easy": ["simple", "light"],
    "clear": ["plain", "evident"],
    "begin": ["start", "open"],
    "help": ["aid", "support"],
    "need": ["require", "want"],
    "often": ["frequently", "regularly"],
}


def _contracted() -> dict[str, str]:
    """Auxiliaries with "not", and pronouns with forms of be, have and will."""
    out = {f"{x} not": f"{x}n't" for x in "do does did is are was were has have had could should would must".split()} | {"cannot": "can't", "can not": "can't", "will not": "won't"}
    for who, be in {"i": "am", "you": "are", "we": "are", "they": "are", "he": "is", "she": "is", "it": "is", "that": "is"}.items():
        short = {"am": "'m", "are": "'re", "is": "'s"}[be]
        out[f"{who} {be}"] = ("I" if who == "i" else who) + short
        if who != "that":
            out[f"{who} will"] = ("I" if who == "i" else who) + "'ll"
    return out | {f"{who} have": f"{'I' if who == 'i' else who}'ve" for who in "i you we they".split()}


CONTRACTIONS = _contracted()

#: name, allow-list, smallest and largest sentence in words, keep_structure, contractions.
STYLES: list[tuple[str, list[str], int, int, bool, bool]] = [
    ("academic", ["consequently", "in conclusion"], 16, 45, False, False),
    ("business", ["robust", "leverage"], 12, 38, True, True),
    ("casual", [], 6, 32, False, True),
    ("creative", ["rich tapestry"], 8, 42, False, True),
]
DEFAULT_STYLE = "academic"

#: plan, words a day (null: no limit), deep rewriting allowed.
PLANS = [("free", 1000, False), ("pro", None, True)]
