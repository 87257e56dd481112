"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from patterns. Three labelers vote on each with 1, 0 or -1: a strict form (regex), a gazetteer (tables of
top-level domains, calling codes, card issuers, reserved addresses, country codes and key names) and the words before it
(context). How often each combination of votes and of a span's shape (length, digits, letters, neighbouring characters, none
of which a labeler sees) occurs is counted over all documents; on that table, whose size no corpus changes,
expectation-maximisation estimates the labelers' reliabilities and a logistic span classifier over votes and shape is fitted
to the posteriors. The classifier then runs as a column expression. Base spans always stay; of the others those it accepts.

Positions are code points, the end exclusive. Defined cases: null and empty texts have no spans; texts are searched whole,
with patterns that neither recurse nor rescan a run of characters; repeated rows are searched each; with no candidate at
all the classifier keeps its prior; other columns are kept by ``redacted`` only, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.materialize import cut, written
from colloquy.llm.common import fresh
from colloquy.llm.spans import blocks, folded, let, matches, part

#: Kinds in the order of reports; the first four are the base.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "ssn", "iban", "local_phone", "spelled_email")
KINDS = BASE + EXTRA
SPAN = "array<struct<kind:int,start:int,stop:int,strict:int,known:int,context:int,shape:int>>"
CONTEXT = 32


@dataclass(frozen=True)
class Source:
    """One kind: what must be in a text, the candidate's pattern, which candidates hold, and the labelers' patterns."""

    gate: str
    pattern: str
    strict: str
    context: str
    least: int = 0
    most: int = 1 << 30


#: Leading guards only skip starts inside a run that has failed as a whole; \G lets a match begin where the last one ended.
SOURCES = {
    "email": Source(
        "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)++",
        r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*+(?<=\.[A-Za-z]{2,24})$", r"(?i)mail|contact|write|reach|from:|to:|correo|courriel",
    ),
    "ip": Source(
        ".", r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
        r"(?i)\bip\b|addr|host|server|client|login|from",
    ),
    "card": Source(
        "", r"[0-9]([\x20-]?[0-9])++", r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5}$",
        r"(?i)card|visa|master|amex|credit|pay|karte|tarjeta|carte", 13, 19,
    ),
    "phone": Source(
        "+", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]+\)?([ .-]?[0-9]+)*$", r"(?i)phone|tel|call|mobile|fax|cell|whatsapp", 9, 15,
    ),
    "secret": Source(
        "", r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+[\"']?",
        r"(?i)[=:]\s*[\"']?(?=[^\"']*[0-9])(?=[^\"']*[a-z])[A-Za-z0-9+/_.-]{10,}", r"(?i)auth|login|export|set|user|key",
    ),
    "ssn": Source("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"(?i)ssn|social|security|tax"),
    "iban": Source("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}", r"(?i)iban|account|bank|konto|cuenta|compte"),
    "local_phone": Source("", r"(?<![0-9+().-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"^(\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$", r"(?i)phone|tel|call|mobile|fax|cell"),
    "spelled_email": Source("", r"(?i)(?<![A-Za-z0-9._-])[a-z0-9._-]{1,64} ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{1,63}){1,4}", r"(?i)dot", r"(?i)mail|contact|write|reach"),
}
#: Fixed values, the gazetteers: top-level domains in wide use and endings of file names and test hosts.
DOMAINS = tuple("ai app ar at au be biz br ca cc ch cl cn co com cz de dev dk edu es eu fi fr gov gr hk hu id ie il in info int io it jp kr me mil mx nl no nz org pl pt ro ru se sg sk tr tv tw ua uk us za net".split())
NO_DOMAINS = tuple("css csv example gif html invalid jpeg jpg js json local localhost md pdf png py svg test txt xml".split())
#: Country calling codes.
CALLING = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 225 233 234 237 243 244 250 251 254 255 256 260 263 "
    "351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 502 503 504 505 506 507 509 591 593 595 598 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
)
#: Leading digits of card issuers, by how many digits say it.
ISSUERS = {1: ("4",), 2: ("34", "36", "37", "38", "50", "51", "52", "53", "54", "55", "56", "57", "58", "62", "63", "65", "67"), 4: ("6011", "2221", "2720"), 3: ("222", "223", "224", "225", "226", "227", "228", "229", "300", "301", "302", "303", "304", "305", "644", "645", "646", "647", "648", "649")}
ISSUERS_TWO_SERIES = ("23", "24", "25", "26", "270", "271")
#: First octets that no public host has, and first pairs of them.
RESERVED, RESERVED_PAIRS = ("0", "10", "127", *map(str, range(224, 256))), ("169.254", "192.168", *(f"172.{n}" for n in range(16, 32)))
#: Countries of account numbers with the number's length.
ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26}
#: Names of keys, and values that only stand for one.
KEY_NAMES, DUMMIES = ("token", "password", "passwd", "secret", "apikey", "accesskey", "privatekey", "pwd"), ("changeme", "password", "yourtoken", "yourpassword", "yourkey", "xxxxxxxx", "example", "placeholder")
#: Cheap patterns that every text with candidates of the kind matches: each says only what its pattern demands.
GATES = {"card": r"[0-9](?:[\x20-]?[0-9]){12}", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "phone": r"\+[0-9][\x20().0-9-]", "email": r"@[A-Za-z0-9-]+\.", "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{8}", "ssn": r"-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "local_phone": r"[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", "spelled_email": r"(?i)[\[(] ?dot ?[\])]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        return total + F.when(at % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    if kind in ("card", "phone"):
        size = F.length(_digits(value))
        right = size.between(SOURCES[kind].least, SOURCES[kind].most)
        return F.when(right, _luhn(value)).otherwise(False) if kind == "card" else right
    return F.lit(True)


def _known(kind: str, value: Column) -> Column:
    """The gazetteer's vote: 1 for a key of the span that its table has, -1 for one that speaks against it, 0 without."""
    digits = _digits(value)
    # one pattern for a table: thousands of literals would make the plan slow to build
    among = lambda column, table, whole=True: column.rlike(f"^(?:{'|'.join(map(re.escape, table))}){'$' if whole else ''}")
    leads = lambda table: among(digits, table, whole=False)
    if kind in ("email", "spelled_email"):
        key = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        yes, no = among(key, DOMAINS), among(key, NO_DOMAINS)
    elif kind == "ip":
        parts = F.split(value, r"\.")
        no = among(parts[0], RESERVED) | among(F.concat_ws(".", parts[0], parts[1]), RESERVED_PAIRS)
        yes = ~no & ~parts[0].startswith("0")
    elif kind == "card":
        yes, no = leads([*(i for n in ISSUERS.values() for i in n), *ISSUERS_TWO_SERIES]), digits.startswith("0")
    elif kind == "phone":
        yes = leads(CALLING)
        no = digits.startswith("0")
    elif kind == "secret":
        held = F.lower(F.regexp_replace(F.regexp_extract(value, r"[=:]\s*[\"']?([^\"']*)", 1), "[^A-Za-z0-9]", ""))
        yes, no = F.lower(F.regexp_replace(F.regexp_extract(value, "^([A-Za-z_-]+)", 1), "[_-]", "")), held
        yes, no = among(yes, KEY_NAMES), among(no, DUMMIES)
    elif kind == "ssn":
        area = F.substring(value, 1, 3)
        no = area.isin("000", "666") | area.startswith("9")
        yes = ~no
    elif kind == "iban":
        sizes = F.expr(f"map({', '.join(f"'{c}', {n}" for c, n in ACCOUNTS.items())})")
        size = F.try_element_at(sizes, F.substring(value, 1, 2))
        yes, no = F.coalesce(size == F.length(F.regexp_replace(value, " ", "")), F.lit(False)), size.isNull()
    else:
        yes, no = digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]|^[0-9]{3}[01]")
    return F.when(no, -1).when(yes, 1).otherwise(0)


#: What a span looks like, each part with its number of values; no labeler sees it.
SHAPE = {"length": 6, "digits": 3, "upper": 2, "lower": 2, "before": 3, "after": 3}


def _shape(text: Column, s: Column) -> Column:
    """One number for the parts of a span's shape; ``text`` in blocks."""
    side = lambda c: F.when(c.rlike("^[A-Za-z0-9]$"), 2).when(F.trim(c) == "", 0).otherwise(1)
    size, value = s["stop"] - s["start"], s["value"]
    digits = F.length(_digits(value))
    parts = {
        "length": F.when(size <= 8, 0).when(size <= 12, 1).when(size <= 16, 2).when(size <= 24, 3).when(size <= 48, 4).otherwise(5),
        "digits": F.when(digits == 0, 0).when(2 * digits < size, 1).otherwise(2),
        "upper": value.rlike("[A-Z]").cast("int"), "lower": value.rlike("[a-z]").cast("int"),
        "before": F.when(s["start"] == 0, 0).otherwise(side(part(text, s["start"] - 1, s["start"]))), "after": side(part(text, s["stop"], s["stop"] + 1)),
    }
    return reduce(lambda code, name: code * SHAPE[name] + parts[name], SHAPE, F.lit(0)).cast("int")


def _found(kind: str, text: Column) -> Column:
    """The spans of one kind with the votes that need nothing but the span."""
    source, valid = SOURCES[kind], "array<struct<kind:int,start:int,stop:int,value:string,strict:int,known:int>>"

    def voted(s: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"),
            F.when(s["value"].rlike(source.strict), 1).otherwise(-1).alias("strict"), _known(kind, s["value"]).alias("known"),
        )

    spans = F.transform(F.filter(matches(text, source.pattern), lambda s: _holds(kind, s["value"])), voted)
    return F.when(text.rlike(GATES[kind]), spans).otherwise(F.array()).cast(valid)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes and shape, by kind and then place."""
    contexts = F.expr("array(" + ", ".join("'" + SOURCES[k].context.replace("\\", "\\\\") + "'" for k in KINDS) + ")")

    def seen(s: Column, cut_up: Column) -> Column:
        before = part(cut_up, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
        context = F.when(F.regexp_like(before, F.get(contexts, s["kind"])), 1).when(before.rlike(r"(?i)isbn|version|figure|section|order (no|number)|ref\."), -1).otherwise(0)
        return F.struct(*(s[n].alias(n) for n in ("kind", "start", "stop", "strict", "known")), context.alias("context"), _shape(cut_up, s).alias("shape"))

    every = F.concat(*(_found(kind, text) for kind in KINDS))
    found = let(every, lambda spans: F.when(F.size(spans) > 0, let(blocks(text), lambda cut_up: F.transform(spans, lambda s: seen(s, cut_up)))))
    return F.coalesce(found, F.array()).cast(SPAN)


def _doubles(values: tuple[float, ...]) -> Column:
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")


@dataclass(frozen=True)
class Classifier:
    """Logistic weights of the bias, the three votes, the kinds and the parts of a shape; and the labelers' reliabilities."""

    weights: tuple[float, ...]
    reliability: tuple[float, ...]
    prior: float

    def probability(self, span: Column) -> Column:
        total = F.lit(self.weights[0])
        for w, name in zip(self.weights[1:4], ("strict", "known", "context")):
            total = total + F.lit(w) * span[name]
        at = 4 + len(KINDS)
        total = total + F.get(_doubles(self.weights[4:at]), span["kind"])
        code = span["shape"]
        for (name, size), first in reversed(list(zip(SHAPE.items(), at + np.cumsum([0, *SHAPE.values()])[:-1]))):
            total = total + F.get(_doubles(self.weights[first : first + size]), code % size)
            code = F.floor(code / size).cast("int")
        return 1 / (1 + F.exp(-total))


def _inputs(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """What the classifier sees, a row for each combination."""
    parts = [np.ones((len(kinds), 1)), votes, np.eye(len(KINDS))[kinds]]
    codes, columns = shapes.copy(), []
    for size in reversed(SHAPE.values()):
        columns.append(np.eye(size)[codes % size])
        codes //= size
    return np.concatenate([*parts, *reversed(columns)], axis=1)


def fitted(counts: list[tuple[int, int, int, int, int, int]], rounds: int = 50) -> Classifier:
    """From (kind, strict, known, context, shape, n), one row for each combination: at most 27 votes by 648 shapes for a kind."""
    start = (0.75, 0.75, 0.65)
    if not counts:
        return Classifier((0.0, 1.0, 1.0, 0.5, *[0.0] * (len(KINDS) + sum(SHAPE.values()))), start, 0.5)
    table = np.array(counts, np.float64)
    kinds, votes, shapes, n = table[:, 0].astype(int), table[:, 1:4], table[:, 4].astype(int), table[:, 5]
    right, prior = np.array(start), np.full(len(KINDS), 0.6)
    for _ in range(rounds):
        odds = np.log(prior[kinds] / (1 - prior[kinds])) + votes @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-odds))
        agree = (votes > 0) * post[:, None] + (votes < 0) * (1 - post)[:, None]
        cast = (votes != 0) * n[:, None]
        # beta priors keep a labeler better than chance and no estimate at 0 or 1
        right = np.clip(((agree * n[:, None]).sum(0) + 8) / (cast.sum(0) + 10), 0.55, 0.99)
        for k in range(len(KINDS)):
            prior[k] = np.clip(((post * n)[kinds == k].sum() + 6) / (n[kinds == k].sum() + 10), 0.05, 0.95)
    odds = np.log(prior[kinds] / (1 - prior[kinds])) + votes @ np.log(right / (1 - right))
    post = 1 / (1 + np.exp(-odds))
    x = _inputs(kinds, votes, shapes)
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(100):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - post)) + 1e-3 * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Classifier(tuple(map(float, w)), tuple(map(float, right)), float((post * share).sum()))


def classifier(spans: DataFrame, name: str = "_spans") -> Classifier:
    """Counts the votes and shapes of all candidates in a column and fits to the counts."""
    votes = spans.select(F.explode(name).alias("s")).groupBy("s.kind", "s.strict", "s.known", "s.context", "s.shape").count()
    return fitted(sorted(tuple(r) for r in votes.collect()))


def accepted(spans: Column, model: Classifier, least: float = 0.5) -> Column:
    """Base spans, and those others that the classifier accepts and that no base span overlaps, by kind and place.

    In order of place, a base span meets another one if the furthest stop of those before it, or the least start of those behind
    it, lies inside; both are carried along.
    """
    is_base = lambda s: s["kind"] < len(BASE)
    kind = "struct<span:struct<start:int,kind:int,stop:int,strict:int,known:int,context:int,shape:int>,kept:boolean>"
    beyond = F.lit(1 << 30)

    def kept(placed: Column) -> Column:
        forward = folded(
            placed, F.lit(0), lambda far, s: F.when(is_base(s), F.greatest(far, s["stop"])).otherwise(far),
            lambda far, s: F.struct(s.alias("span"), (is_base(s) | ((far <= s["start"]) & (model.probability(s) >= least))).alias("kept")), kind,
        )
        backward = folded(
            F.reverse(F.filter(forward, lambda x: x["kept"])), beyond, lambda near, x: F.when(is_base(x["span"]), F.least(near, x["span"]["start"])).otherwise(near),
            lambda near, x: F.struct(x["span"].alias("span"), (is_base(x["span"]) | (near >= x["span"]["stop"])).alias("kept")), kind,
        )
        names = ("kind", "start", "stop", "strict", "known", "context", "shape")
        return F.sort_array(F.transform(F.filter(backward, lambda x: x["kept"]), lambda x: F.struct(*(x["span"][n].alias(n) for n in names))))

    # in place a base span stands before others that begin where it does
    by_place = F.sort_array(F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in ("start", "kind", "stop", "strict", "known", "context", "shape")))))
    return F.when(F.exists(spans, lambda s: ~is_base(s)), let(by_place, kept)).otherwise(spans)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, spans): an array of (kind, start, stop, votes) by kind and place."""
    spans = cut(docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("_spans")))
    return spans.select("doc_id", accepted(F.col("_spans"), classifier(spans)).alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew."""
    held = fresh(docs, "spans")
    spans = written(docs.withColumn(held, candidates(F.coalesce("text", F.lit("")))), "spans")
    model = classifier(spans, held)
    names = F.array(*map(F.lit, KINDS))
    text = F.col("text")

    def built(placed: Column) -> Column:
        # each span with the end of the one before, or nothing where it begins inside that one
        spread = folded(
            placed, F.lit(0), lambda at, s: F.greatest(at, s["stop"]),
            lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), "struct<at:int,start:int,kind:int>",
        )
        shown = lambda cut_up: F.transform(F.filter(spread, lambda s: s.isNotNull()), lambda s: F.concat(part(cut_up, s["at"], s["start"]), F.lit("["), F.upper(F.get(names, s["kind"])), F.lit("]")))
        last = F.array_max(F.transform(placed, lambda s: s["stop"]))
        return let(blocks(text), lambda cut_up: F.concat(F.array_join(shown(cut_up), ""), part(cut_up, last, F.length(text))))

    # in order of place; a span that begins inside an earlier one is covered by it
    placed = F.sort_array(F.transform(accepted(F.col(held), model), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    changed = spans.withColumn("text", F.when(F.size(held) > 0, let(placed, built)).otherwise(text)).drop(held)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed
