"""License detection by ordered signature rules, in DataFrame functions alone and without a shuffle.

Base phrases are found at every place. Beyond them, several hundred signatures run in order of priority: hand-written ones
of the licenses' own sentences, headers, exceptions, ranges and dual licensing (``license_texts``), and license families in
the forms that identifiers, links, tags and plain sentences give them. A signature's regex runs on a text only if one of its keywords is in it,
and no signature runs unless the words of one gate are there. Every match is an interval; one that lies inside a match of no lower
priority is suppressed, of equal intervals the earlier rule stays, and the rest name the labels. The names of one identifier
expression stand beside each other.

Defined cases: null and empty texts have no words, places or labels and score 0; texts are searched whole; repeated rows
are scanned each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import license_texts
from colloquy.llm.spans import folded, let, matches

#: A word's characters after A-Z in lower case, said so that letters of either case are in it.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keywords of which one must be present, name of the license as a regex, SPDX-style identifier as a regex.
FAMILIES = (
    ("mit", "mit|expat|x11", r"(?:mit|expat|x11)", r"mit(?:-0)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?,? ?(?:version|v)? ?2(?:\.0)?", r"apache-2\.0"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?,? ?(?:version|v)? ?1\.[01]", r"apache-1\.[01]"),
    ("gpl-1", "gnu|gpl", r"gnu general public license,? ?(?:version|v) ?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    ("gpl-2", "gnu|gpl", r"gnu general public license,? ?(?:version|v) ?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3", "gnu|gpl", r"gnu general public license,? ?(?:version|v) ?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("gpl", "gnu|gpl", r"gnu (?:general public license|gpl)", r"gpl"),
    ("lgpl-2", "gnu|lgpl", r"gnu (?:lesser|library) general public license,? ?(?:version|v) ?2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", "gnu|lgpl", r"gnu lesser general public license,? ?(?:version|v) ?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3", "gnu|lgpl", r"gnu lesser general public license,? ?(?:version|v) ?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("lgpl", "gnu|lgpl", r"gnu (?:lesser|library) general public license", r"lgpl"),
    ("agpl-3", "affero|agpl", r"gnu affero general public license,? ?(?:version|v) ?3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later|\+)?"),
    ("agpl", "affero|agpl", r"(?:gnu )?affero general public license", r"agpl"),
    ("gfdl", "gnu|gfdl", r"gnu free documentation license(?:,? ?(?:version|v) ?1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("bsd-2-clause", "bsd", r"(?:2|two)[- ]clause bsd|simplified bsd|freebsd", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:3|three)[- ]clause bsd|(?:new|modified|revised) bsd", r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:4|four)[- ]clause bsd|original bsd", r"bsd-4-clause"),
    ("bsd", "berkeley|bsd", r"(?:berkeley software distribution|bsd)(?:-style)?", r"bsd"),
    ("0bsd", "bsd", r"zero[- ]clause bsd|0bsd", r"0bsd"),
    ("isc", "isc|internet", r"(?:isc|internet systems consortium)", r"isc"),
    ("mpl-1", "mozilla|mpl", r"mozilla public license,? ?(?:version|v)? ?1\.[01]", r"mpl-1\.[01]"),
    ("mpl-2", "mozilla|mpl", r"mozilla public license,? ?(?:version|v)? ?2(?:\.0)?", r"mpl-2\.0"),
    ("mpl", "mozilla|mpl", r"mozilla public license", r"mpl"),
    ("epl-1", "eclipse|epl", r"eclipse public license,? ?(?:version|v|-)? ?1(?:\.0)?", r"epl-1\.0"),
    ("epl-2", "eclipse|epl", r"eclipse public license,? ?(?:version|v|-)? ?2(?:\.0)?", r"epl-2\.0"),
    ("cddl", "distribution|cddl", r"common development and distribution license", r"cddl-1\.[01]"),
    ("cpl", "common|cpl", r"common public license", r"cpl-1\.0"),
    ("eupl", "european|eupl", r"european union public licen[cs]e", r"eupl-1\.[012]"),
    ("artistic-1", "artistic", r"artistic license(?:,? ?(?:version|v)? ?1(?:\.0)?)?", r"artistic-1\.0"),
    ("artistic-2", "artistic", r"artistic license,? ?(?:version|v)? ?2(?:\.0)?", r"artistic-2\.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?"),
    ("boost", "boost|bsl", r"boost software license", r"bsl-1\.0"),
    ("busl", "business|busl", r"business source license", r"busl-1\.1"),
    ("sspl", "server|sspl", r"server side public license", r"sspl-1\.0"),
    ("elastic", "elastic", r"elastic license(?: 2(?:\.0)?)?", r"elastic-2\.0"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|want", r"do what the f\w+ you want to public license|wtfpl", r"wtfpl"),
    ("python", "python|psf", r"python software foundation license|psf license", r"(?:psf|python)-2\.0"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("php", "php", r"php license(?:,? ?version 3(?:\.01?)?)?", r"php-3\.01?"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("ofl", "font|ofl", r"sil open font license", r"ofl-1\.[01]"),
    ("odbl", "database|odbl", r"open database license", r"odbl-1\.0"),
    ("odc-by", "commons|odc", r"open data commons attribution license", r"odc-by-1\.0"),
    ("pddl", "dedication|pddl", r"public domain dedication and license", r"pddl-1\.0"),
    ("cc0", "cc0|creative", r"cc0|creative commons zero", r"cc0-1\.0"),
    ("cc-by", "cc|creative", r"(?:cc by|creative commons attribution)(?: [1-4]\.[05])?", r"cc-by-[1-4]\.[05]"),
    ("cc-by-sa", "cc|creative", r"(?:cc by-sa|creative commons attribution-?share-?alike)(?: [1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]"),
    ("cc-by-nd", "cc|creative", r"(?:cc by-nd|creative commons attribution-?no-?deriv\w+)(?: [1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]"),
    ("cc-by-nc", "cc|creative", r"(?:cc by-nc|creative commons attribution-?non-?commercial)(?: [1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]"),
    ("cc-by-nc-sa", "cc|creative", r"(?:cc by-nc-sa|creative commons attribution-?non-?commercial-?share-?alike)(?: [1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]"),
    ("cc-by-nc-nd", "cc|creative", r"(?:cc by-nc-nd|creative commons attribution-?non-?commercial-?no-?deriv\w+)(?: [1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?:-[ms]+)?", r"openrail"),
    ("ms-pl", "microsoft|ms-pl", r"microsoft public license", r"ms-pl"),
    ("ms-rl", "microsoft|ms-rl", r"microsoft reciprocal license", r"ms-rl"),
    ("apsl", "apple|apsl", r"apple public source license", r"apsl-2\.0"),
    ("ncsa", "illinois|ncsa", r"university of illinois/?(?:ncsa)? open source license", r"ncsa"),
    ("w3c", "w3c", r"w3c software notice", r"w3c"),
    ("vim", "vim", r"vim", r"vim"),
)
#: What stands for a space of a signature: white space and the marks of wrapped comments.
GAP = r"[\s*#/>]+"
#: Words before the name in a licensing sentence.
VERBS = ("licensed", "released", "distributed", "available", "published", "covered", "provided")
UNDER = rf"(?:{'|'.join(VERBS)})(?: \w+)? under"
#: Names of one expression begin at its tag, so none of them hides another; they hide all that is weaker.
EXPRESSION = 5
_TABLE = "array<struct<keys:array<array<string>>,rules:array<struct<rule:int,label:string,keywords:string,pattern:string,priority:int,score:double>>>>"
DETECTION = "struct<start:int,stop:int,label:string,score:double>"


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: str  # bars between alternatives, blanks between the words of one, all of which a match holds; no break parts a word
    pattern: str
    priority: int
    score: float


def _spaced(pattern: str) -> str:
    """A space in a signature stands for any white space, quotes of wrapped comments included."""
    return pattern.replace(", ", ",? ").replace(" ", GAP)


def _held(phrase: str) -> list[str]:
    """Words that every match of a hand-written phrase holds: those outside of groups, classes and options."""
    flat, depth, alternatives = "", 0, False
    for at, c in enumerate(re.sub(r"\\.", "~", re.sub(r"\[[^\]]*\]\??", "~", phrase))):
        depth += (c == "(") - (c == ")")
        alternatives |= c == "|" and depth == 0
        flat += "~" if depth or c == ")" else c
    words = [w.strip(",;:-") for w in flat.split()]
    return [] if alternatives else [w for w in dict.fromkeys(words) if re.fullmatch("[a-z]{4,}", w)]


def _written() -> list[Rule]:
    """The hand-written signatures, each behind its keywords and the longest words that it holds besides."""
    parts = [(license_texts.BODIES, 4, 1.0), (license_texts.EXCEPTIONS, 4, 1.0), (license_texts.NOTICES, 3, 0.95), (license_texts.CONTENT, 3, 0.95)]
    rows = [(label, keys, p, priority, score) for part, priority, score in parts for label, keys, p in part]
    rows += [(label, keys, p, 1, score) for label, keys, p, score in license_texts.RIGHTS]
    out = []
    for label, keys, p, priority, score in rows:
        more = sorted(_held(p), key=lambda w: (w not in TELLING, w in COMMON, -len(w)))[:4]
        keywords = "|".join(" ".join(dict.fromkeys([*more, k])) for k in keys.split("|"))
        out.append(Rule(label, keywords, rf"(?<![\w]){_spaced(p)}", priority, score))
    return out


def rules() -> list[Rule]:
    """All signatures, strongest first: sentences of licenses, identifiers and links, licensing sentences, bare names."""
    out = _written()
    for label, keys, name, spdx in FAMILIES:
        name = _spaced(name)
        whole = rf"{spdx}(?![\w.-])"
        both = lambda more: "|".join(f"{k} {m}" if m not in k else k for k in keys.split("|") for m in more.split("|"))  # noqa: E731, B023
        forms = (
            # names before this one in an expression are passed by without a step back
            (both("spdx"), rf"spdx-license-identifier:[ \t]*(?:(?!\(*{whole})[\w.+()-]++ (?:or|and|with) )*+\(*{whole}", EXPRESSION, 1.0),
            (both("license|licence"), rf"licen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?{spdx}(?![\w-])", 3, 0.95),
            (both("licenses"), rf"https?://[\w./-]*/licenses/{spdx}(?![\w-])", 3, 0.95),
            (both("under"), _spaced(UNDER + r"(?: the)?(?: terms of)?(?: the)?(?: conditions of)?") + rf"[\s*#/>]+(?:the[\s*#/>]+)?(?:{name})(?![\w])", 3, 0.9),
            (both("license|licence"), rf"(?<![\w])(?:{name})(?:[- ]style)?[\s*#/>]+licen[cs]e(?![\w])", 2, 0.8),
            (BARE.get(label) or both("license|licence"), rf"(?<![\w])(?:{name if 'licen' in name or 'creative' in name else name + r'[\s*#/>]+licen[cs]e'})(?![\w])", 2, 0.7),
        )
        out += [Rule(label, keywords, pattern, priority, score) for keywords, pattern, priority, score in forms]
    return sorted(dict.fromkeys(out), key=lambda r: -r.priority)


#: Words so common that to find one says nothing.
COMMON = frozenset("this that with from under have been were which what your will would their there about other some such only also into more than most made make used uses using like over when where each them they then these those shall must without within between after before file files code work text name names terms notice software program version public source free copy copies form forms make rights document documents data made part following provided available distributed released published covered good just want contents change date third service special subject person purpose other either".split())
#: Names that can stand without the word license.
BARE = {
    "apache-2": "apache", "apache-1": "apache", "gpl": "gnu gpl|gnu license", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "bsd-4-clause": "bsd", "0bsd": "bsd", "wtfpl": "wtfpl|want license",
    "cc0": "cc0|creative commons", "openrail": "open rail", **dict.fromkeys(("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"), "cc by|creative commons"),
}
#: Words that most licenses have one of.
TELLING = ("license", "licence", "licensed", "permission", "copyright", "redistribution")


def gates(known: list[Rule]) -> list[tuple[str, ...]]:
    """Few sets of words of which every match of any rule holds one whole: telling words that most rules share, taken one by
    one, and for rules without any all their words."""
    left = {frozenset(a.split()) for r in known for a in r.keywords.split("|")}
    left = {a for a in left if len(a) != 2 or not ("under" in a or a == {"cc", "by"})}  # these ``gated`` looks for apart
    found: list[tuple[str, ...]] = []
    while left:
        counts = Counter(w for a in left for w in a if w not in COMMON and len(w) > 3)
        if not counts:
            return found + sorted(tuple(sorted(a, key=lambda w: (w in COMMON, -len(w)))) for a in left)
        word = min(counts, key=lambda w: (-counts[w], w))
        found.append((word,))
        left = {a for a in left if not any(word in w for w in a)}
    return found


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _phrase(phrase: str) -> str:
    return rf"(?i)(?<!{WORD}){rf'{BREAK}+'.join(map(re.escape, phrase.split()))}(?!{WORD})"


def _said(value: object) -> str:
    """A list, record, string or number as a SQL literal."""
    if isinstance(value, list):
        return f"array({', '.join(map(_said, value))})"
    if isinstance(value, dict):
        return f"named_struct({', '.join(f'{_said(k)}, {_said(v)}' for k, v in value.items())})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def detections(lower: Column, known: list[Rule] | None = None) -> Column:
    """What stays of all matches in a lower-cased text: an array of (start, stop, label, score) in order of place."""
    known = known if known is not None else rules()
    families: dict[str, list[dict]] = {}
    for i, r in enumerate(known):
        families.setdefault(r.keywords, []).append({"rule": i, **asdict(r)})
    table = F.expr(_said([{"keys": [a.split() for a in k.split("|")], "rules": v} for k, v in families.items()])).cast(_TABLE)  # folded when the plan is made

    def matched(rule: Column) -> Column:
        return F.transform(
            matches(lower, rule["pattern"]),
            lambda m: F.struct(
                m["start"].alias("start"), (-m["stop"]).alias("last"), (-rule["priority"]).alias("weakness"), rule["rule"].alias("rule"),
                rule["label"].alias("label"), rule["score"].alias("score"),
            ),
        )

    every_word = F.expr(_said(sorted({w for k in families for w in k.replace("|", " ").split()}))).cast("array<string>")
    # each word is looked for once in the text, and the rules' keywords among the few that are there
    present = let(F.filter(every_word, lambda w: F.contains(lower, w)), lambda there: F.filter(table, lambda f: F.exists(f["keys"], lambda words: F.forall(words, lambda w: F.array_contains(there, w)))))
    every = F.sort_array(F.flatten(F.transform(F.flatten(F.transform(present, lambda f: f["rules"])), matched)))
    levels = sorted({r.priority for r in known})
    # in this order a match lies inside an earlier one of its priority or above iff the furthest stop of those reaches its own
    reached = F.struct(*(F.lit(-1).alias(f"p{p}") for p in levels))

    def reach(a: Column, d: Column) -> Column:
        return F.struct(*(F.when(d["weakness"] == -p, F.greatest(a[f"p{p}"], -d["last"])).otherwise(a[f"p{p}"]).alias(f"p{p}") for p in levels))

    def kept(a: Column, d: Column) -> Column:
        stop, priority = -d["last"], -d["weakness"]
        covered = reduce(lambda x, y: x | y, (((priority < p) if p == EXPRESSION else (priority <= p)) & (a[f"p{p}"] >= stop) for p in levels))
        return F.when(~covered, F.struct(d["start"].alias("start"), stop.alias("stop"), d["label"].alias("label"), d["score"].alias("score")))

    return let(every, lambda found: F.filter(folded(found, reached, reach, kept, DETECTION), lambda d: d.isNotNull()))


#: The short name of a license whose words are too common to look for apart.
CC_BY = rf"(?i)cc{BREAK}+by"


def gated(text: Column, known: list[Rule]) -> Column:
    """(rules, base): whether any rule, and whether a base phrase, may match a text. It is put in lower case once."""
    every = lambda low, words: reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words))

    def opened(low: Column) -> Column:
        short = F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by")) & low.rlike(CC_BY)
        under = F.contains(low, F.lit("under")) & reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in VERBS))
        rule = reduce(lambda a, b: a | b, (every(low, g) for g in gates(known)), under | short)
        return F.struct(rule.alias("rules"), (F.contains(low, F.lit("license")) | short).alias("base"))

    return let(F.lower(text), opened)


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def scanned(docs: DataFrame, known: list[Rule] | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    phrases = {label: _phrase(phrase) for phrase, label in BASE.items()}
    any_phrase = "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in phrases.values())
    known = known if known is not None else rules()
    found = docs.select("doc_id", text.alias("_text"), gated(text, known).alias("_open"))
    counted = found.select(
        "doc_id", "_text", F.col("_open.rules").alias("_gated"), F.when(F.col("_open.base"), F.regexp_count("_text", F.lit(any_phrase))).otherwise(0).alias("_base"),
        F.when(F.col("_open.rules"), ascii_lower(F.col("_text"))).alias("_lower"),
    )
    has = F.col("_base") > 0
    pieces = F.split("_text", any_phrase, -1)
    tail = F.element_at(pieces, -1)
    labels = F.array(*(F.when(F.col("_text").rlike(p), F.lit(label)) for label, p in phrases.items()))
    spans = F.when(F.col("_gated"), detections(F.col("_lower"), known))
    table = counted.select(
        "doc_id", "_base", spans.alias("detections"),
        _words(F.col("_text")).cast("long").alias("n_words"),
        F.when(has, _words(pieces[0])).cast("long").alias("first_word"),
        F.when(has, _words(tail)).alias("_after"),
        F.when(has, F.array_sort(F.array_compact(labels))).otherwise(F.array().cast("array<string>")).alias("_labels"),
        F.when(has, F.size(F.split(F.element_at(F.regexp_extract_all("_text", F.lit(any_phrase), F.lit(0)), -1), f"{BREAK}+"))).alias("_size"),
    )
    own = F.flatten(F.transform(F.coalesce("detections", F.array().cast(f"array<{DETECTION}>")), lambda d: F.split(d["label"], r"\|")))
    best = F.array_max(F.transform("detections", lambda d: d["score"]))
    return table.select(
        "doc_id", "n_words", F.col("_base").cast("long").alias("n_base"), "first_word",
        (F.col("n_words") - F.col("_after") - F.col("_size")).cast("long").alias("last_word"),
        F.array_join("_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_labels", own))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("_base") > 0, 0.9).otherwise(0.0)).alias("score"),
        "detections",
    )
