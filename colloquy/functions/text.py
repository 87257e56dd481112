"""Text functions as column expressions; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of a second script beside Latin; its words need two letters at least.
OTHER_SCRIPT = "\\x{1000}-\\x{109F}"
LATIN_WORD = r"[A-Za-z][A-Za-z0-9+#-]*"
URL = r"(?i:https?://)\S+"
#: Word boundaries that combining marks do not disturb.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def nonblank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) > 0


def quoted(text: str) -> str:
    """A literal inside a regex."""
    return "".join(c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c for c in text)


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Distinct lower-cased Latin words and words of the other script, without stopwords."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(f"({LATIN_WORD})"), F.lit(1)), F.lower)
    other = F.regexp_extract_all(text, F.lit(f"([{OTHER_SCRIPT}]{{2,}})"), F.lit(1))
    found = F.array_union(latin, other)
    return F.array_except(found, F.array(*map(F.lit, stopwords))) if stopwords else found


def scoring_tokens(text: Column) -> Column:
    """All lower-cased alphanumeric runs, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([A-Za-z0-9]+|[{OTHER_SCRIPT}]+)"), F.lit(1))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct lower-cased character n-grams; a shorter text is its own gram, an empty one has none."""
    low = F.lower(text)
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    grams = chars
    for k in range(1, n):  # the characters moved by k places: linear, where a substring at each place is not
        grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    whole = F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))
    return F.when(F.length(low) >= n, whole).when(F.length(low) > 0, F.array(low)).otherwise(F.array().cast("array<string>"))


def windows(text: Column, size: int = 1500) -> Column:
    """Fixed windows of a stripped text, in order, without overlap; none of a blank one."""
    return F.regexp_extract_all(strip(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def contains_any(text: Column, hints: Sequence[str]) -> Column:
    """Whether any hint is a substring, case aside."""
    return let(F.lower(text), lambda low: has_any(low, hints))


def has_any(lowered: Column, hints: Sequence[str]) -> Column:
    """Whether a text that is in lower case has any of the hints; literal searches, the shortest first."""
    found = (F.contains(lowered, F.lit(h.lower())) for h in sorted(set(hints), key=lambda h: (len(h), h)))
    return F.coalesce(reduce(lambda a, b: a | b, found, F.lit(False)), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clipped(text: Column, most: int, mark: str = "") -> Column:
    """At most so many characters, white space off the end, with a mark where something was cut."""
    cut = F.regexp_replace(F.substring(text, F.lit(1), F.lit(most)), r"(?U)[\s\x1c-\x1f]+\z", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit(mark))).otherwise(text)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def squeezed(text: Column) -> Column:
    """Runs of blanks and tabs as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def without_markdown(text: Column) -> Column:
    """Fences to a space, inline code and links that hold something to what they hold, marks to spaces."""
    steps = ((r"(?s)```.*?```", " "), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[#*_>]+", " "))
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def without_code(text: Column) -> Column:
    """Fenced blocks and inline code to a space each."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), "`[^`]+`", " ")


def _depth(marks: Column, opening: str) -> Column:
    """The most parentheses of a string of parentheses that are open at once, read from the side ``opening`` opens."""
    step = lambda a, c: F.when(c == opening, F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))).otherwise(F.struct(F.greatest(a["now"] - 1, F.lit(0)).alias("now"), a["most"].alias("most")))
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def up_to_last(text: Column, marks: str, change: Callable[[Column], Column]) -> Column:
    """``change`` of a text up to its last one of ``marks``; what is behind it stays as it is and is not searched."""
    def last(t: Column) -> Column:
        back = let(F.reverse(t), lambda r: F.array(*(F.locate(m, r) for m in marks)))
        return let(F.array_min(F.filter(back, lambda n: n > 0)), lambda n: F.coalesce(F.length(t) - n + 1, F.lit(0)))

    return let(text, lambda t: let(last(t), lambda n: F.concat(change(F.substring(t, F.lit(1), n)), F.substring(t, n + 1, F.length(t)))))


def without_parentheses(text: Column, keep_script: str | None = None, mark: str = " ") -> Column:
    """Parentheses to a space, the innermost first, until none is left but those that hold the kept script (and what is
    around these). As many passes as they are nested deep, which no nesting of both sides exceeds."""
    # possessive, so that one that is never closed is read once and not again from each of its places
    guard = f"(?![^(){keep_script}]*+[{keep_script}])" if keep_script else ""
    step = lambda t, _: F.regexp_replace(t, rf"\({guard}[^()]*+\)", mark)
    deep = lambda m: F.least(_depth(m, "("), _depth(F.reverse(m), ")"))
    peeled = lambda t: let(let(F.regexp_replace(t, "[^()]", ""), deep), lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), t, step)).otherwise(t))
    return let(text, lambda t: F.when(F.contains(t, F.lit("(")), peeled(t)).otherwise(t))


def without_urls(text: Column) -> Column:
    """Addresses to a space, then blanks and empty lines collapsed."""
    return strip(collapsed(F.regexp_replace(text, URL, " ")))


def outside_urls(text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to what lies between URLs, the URLs as they are."""
    between, urls = F.split(text, URL, -1), F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    parts = F.zip_with(F.transform(between, change), urls, lambda b, u: F.concat(b, F.coalesce(u, F.lit(""))))
    return F.array_join(parts, "")


def is_table_separator(line: Column) -> Column:
    """A rule of dashes, colons and bars."""
    return strip(line).rlike(r"(?U)^\|?[\s:|-]+\|?$") & F.contains(line, F.lit("-"))


def is_table_row(line: Column) -> Column:
    return strip(line).rlike(r"(?s)^\|.*\|") & ~is_table_separator(line)


def row_phrase(line: Column, joint: str = "၊ ") -> Column:
    """The cells of a table row, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(line, r"\|"), squeezed), lambda c: c != ""), joint)


def sentences(text: Column) -> Column:
    """Split after ``။``, ``?``, ``!`` and after dots that end a sentence: before white space or the end, and neither in a
    number nor after an abbreviation of one to three letters. Blanks are squeezed."""
    marked = F.regexp_replace(text, r"([။?!])", "$1\u0001")
    marked = F.regexp_replace(marked, r"(?U)(?<![A-Za-z])\.(?=[\s\x1c-\x1f]|\z)|(?<=[A-Za-z]{4})\.(?=[\s\x1c-\x1f]|\z)", ".\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), squeezed), lambda s: s != "")


#: Words of courtesy that cannot stand as a sentence, and the marks that end one.
COURTESY, ENDS = "ခင်ဗျာ|ရှင်|ဗျာ", "။?!"
#: What parts the phrases of a speech.
PAUSE = "\u001e"


def courtesy_joined(text: Column) -> Column:
    """A word of courtesy that stands as a sentence of its own made the end of the sentence before it, whose marks it takes the
    place of; chains of them too, as the mark after each is looked at only."""
    # a run of marks is tried from its first one
    pattern = rf"(?U)(?<![{ENDS}]\s{{0,8}})[{ENDS}](?:\s*+[{ENDS}])*+\s+({COURTESY})\s*(?=[{ENDS}])"
    return F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in COURTESY.split("|"))), F.regexp_replace(text, pattern, " $1")).otherwise(text)


#: Before a part, and before one that is joined to the part before.
_PART, _JOINT = "\u0001", "\u0001\u0001"


def _joined(parts: Column, belongs: Callable[[Column], Column], shown: Callable[[Column], Column], before: str) -> Column:
    """Parts that belong to the part before, as ``shown``, joined to it in one pass; what matches ``before`` in front of them goes."""
    placed = F.transform(parts, lambda p, i: F.when((i > 0) & belongs(p), F.concat(F.lit(_JOINT), shown(p))).otherwise(F.concat(F.lit(_PART), p)))
    whole = F.regexp_replace(F.array_join(placed, ""), f"(?U)(?:{before}){_JOINT}", "")
    return F.slice(F.split(whole, _PART, -1), 2, F.greatest(F.size(parts), F.lit(1)))


def courtesy_merged(parts: Column) -> Column:
    """Phrases of courtesy alone joined to the phrase before, whose end mark gives way to theirs."""
    word = lambda p: F.regexp_extract(strip(p), rf"(?U)^({COURTESY})\s*[{ENDS}]+$", 1)
    shown = lambda p: F.concat(F.lit(" "), word(p), F.regexp_extract(strip(p), f"([{ENDS}]+)$", 1))
    return let(parts, lambda ps: F.when(F.exists(ps, lambda p: word(p) != ""), _joined(ps, lambda p: word(p) != "", shown, rf"[{ENDS}]+\s*|\s*")).otherwise(ps))


def phrases(text: Column) -> Column:
    """Speakable phrases of markdown: table rows as one phrase each, other lines by sentence, in order."""
    clean = without_parentheses(without_markdown(courtesy_joined(text)), OTHER_SCRIPT)
    # only lines with a bar or a dash can be of a table
    spoken = lambda s: F.when(~s.rlike("[|-]"), sentences(s)).when(is_table_separator(s), F.array().cast("array<string>")).when(is_table_row(s), F.filter(F.array(row_phrase(s)), lambda p: p != "")).otherwise(sentences(s))
    return courtesy_merged(F.flatten(F.transform(F.split(clean, "\n"), spoken)))


def speakable_text(text: Column) -> Column:
    """All phrases, parted by pauses."""
    return strip(F.array_join(phrases(text), PAUSE))


def leading_particles_off(text: Column, particles: Sequence[str] = tuple(COURTESY.split("|")), joints: str = "၊, \t\n\r") -> Column:
    """Without white space, particles and what joins them at the beginning."""
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "")
    return F.regexp_replace(bare, rf"^((?:{'|'.join(map(quoted, particles))})[{joints}]*+)++", "")


#: The polite ending that takes the place of a particle, and endings that need none.
POLITE, POLITE_ENDINGS = "ပါ", ("ပါ", "တယ်")


def finals_thinned(text: Column, particles: str = COURTESY, polite: str = POLITE, endings: Sequence[str] = POLITE_ENDINGS, marks: str = ENDS) -> Column:
    """All sentence-final particles but the last give way to the polite ending, or to nothing after a text that ends so.

    The text is cut once at the particles, with the white space and the mark after each; pieces are put together in order.
    """
    pattern = rf"(?U)({particles})(\s*)([{marks}])"
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))

    def joined(parts: Column) -> Column:
        before, spaces, ends, whole = (parts[n] for n in ("before", "spaces", "ends", "whole"))

        def piece(m: Column, i: Column) -> Column:
            prefix = F.get(before, i)
            said = reduce(lambda a, b: a | b, (F.endswith(prefix, F.lit(e)) for e in endings))
            new = F.concat(F.when(said, F.lit("")).otherwise(F.lit(polite)), F.get(spaces, i), F.get(ends, i))
            return F.concat(prefix, F.when(i < F.size(whole) - 1, new).otherwise(m))

        return F.concat(F.array_join(F.transform(whole, piece), ""), F.element_at(before, -1))

    parts = F.struct(F.split(text, pattern, -1).alias("before"), group(2).alias("spaces"), group(3).alias("ends"), group(0).alias("whole"))
    return F.when(text.rlike(pattern), let(parts, joined)).otherwise(text)


def orphans_merged(parts: Column, is_orphan: Callable[[Column], Column], joint: str = " ") -> Column:
    """Phrases that cannot stand alone joined to the phrase before; chains of them too."""
    return let(parts, lambda ps: F.when(F.exists(ps, is_orphan), _joined(ps, is_orphan, lambda p: F.concat(F.lit(joint), p), "")).otherwise(ps))


def name_candidates(text: Column, blocked: Sequence[str]) -> Column:
    """Spans of two to four capitalised words, "Dr" before them allowed, outside addresses, none blocked (full stops at its ends
    aside), case-folded distinct in order."""
    spans = F.regexp_extract_all(F.regexp_replace(text, URL, "\n"), F.lit(r"((?:Dr\.?[ ]+)?[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+){1,3})"), F.lit(1))
    words = lambda s: F.transform(F.split(F.regexp_replace(F.lower(s), r"^dr\.?\s+", ""), " +"), lambda w: F.regexp_replace(w, r"^\.+|\.+\z", ""))
    clear = F.filter(spans, lambda s: ~F.arrays_overlap(words(s), F.array(*map(F.lit, blocked)))) if blocked else spans
    return first_of_each(clear)


def first_of_each(values: Column) -> Column:
    """Distinct by lower case; the first spelling stays."""
    low = lambda vs: F.transform(vs, F.lower)
    # sorted by (lower case, place), the first of each run of equals; then back in order of place
    placed = lambda vs: F.array_sort(F.transform(vs, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("i"), v.alias("v"))))
    first = lambda ps: F.filter(F.transform(ps, lambda p, k: F.when((k == 0) | (F.get(ps, k - 1)["low"] != p["low"]), F.struct(p["i"].alias("i"), p["v"].alias("v")))), lambda p: p.isNotNull())
    sifted = lambda vs: F.transform(F.array_sort(let(placed(vs), first)), lambda p: p["v"])
    return let(values, lambda vs: F.when(F.size(F.array_distinct(low(vs))) == F.size(vs), vs).otherwise(sifted(vs)))


def replaced(text: Column, entries: dict[str, str], whole_words: bool = False, ignore_case: bool = False) -> Column:
    """Dictionary replacement one key after the other, the longest first; a result may be a later key's input."""
    for key in sorted(entries, key=lambda k: (-len(k), k)):
        pattern = (BEFORE if whole_words else "") + quoted(key) + (AFTER if whole_words else "")
        value = entries[key].replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, ("(?i)" if ignore_case else "") + pattern, value)
    return text


#: Numerals and letters as they sound, and numerals that are words or letters as well.
NUMERALS = {
    "I": "ဝမ်း", "II": "တူး", "III": "သရီး", "IV": "ဖိုး", "V": "ဖိုက်", "VI": "ဆစ်", "VII": "ဆဗင်း", "VIII": "အိတ်", "IX": "နိုင်း", "X": "တန်း",
    "XI": "အီလဲဗန်း", "XII": "တွဲ", "XIII": "သာတင်း", "XIV": "ဖိုးတင်း", "XV": "ဖစ်တင်း", "XVI": "ဆစ်တင်း", "XVII": "ဆဗင်းတင်း", "XVIII": "အိတ်တင်း", "XIX": "နိုင်းတင်း", "XX": "ထွယ်တီ",
}
LETTERS = {
    "A": "အေ", "B": "ဘီ", "C": "စီ", "D": "ဒီ", "E": "အီ", "F": "အက်ဖ်", "G": "ဂျီ", "H": "အိပ်ချ်", "I": "အိုင်", "J": "ဂျေ", "K": "ကေ", "L": "အယ်လ်", "M": "အမ်",
    "N": "အန်", "O": "အို", "P": "ပီ", "Q": "ကျူ", "R": "အာရ်", "S": "အက်စ်", "T": "တီ", "U": "ယူ", "V": "ဗွီ", "W": "ဒဗလျူ", "X": "အိတ်စ်", "Y": "ဝိုင်", "Z": "ဇက်ဒ်",
    "0": "ဇီးရိုး", "1": "ဝမ်း", "2": "တူး", "3": "သရီး", "4": "ဖိုး", "5": "ဖိုက်", "6": "ဆစ်", "7": "ဆဗင်း", "8": "အိတ်", "9": "နိုင်း",
}
AMBIGUOUS = ("I", "V", "X")


def is_ambiguous(token: Column) -> Column:
    return F.upper(token).isin(*AMBIGUOUS)


def is_roman(token: Column, numerals: Iterable[str] = tuple(NUMERALS)) -> Column:
    """A numeral, in capitals or not, that can be nothing else."""
    sure = [n for n in numerals if n not in AMBIGUOUS and len(n) > 1]
    return F.upper(token).isin(*sure) & ~token.rlike("[0-9]")


def token_kind(token: Column, numerals: Iterable[str] = tuple(NUMERALS)) -> Column:
    """roman, word or spell: what to do with a Latin token that nothing else explains."""
    mixed = token.rlike("[a-z]") & token.rlike("[A-Z]")
    return (
        F.when(is_roman(token, numerals), "roman")
        .when(is_ambiguous(token), "word")
        .when((F.length(token) == 2) & (F.upper(token) == token) & token.rlike("[A-Z]"), "spell")
        .when(token.rlike("[A-Za-z]") & token.rlike("[0-9]"), "spell")
        .when(mixed & (F.length(token) >= 8), "spell")
        .otherwise("word")
    )


def spelled(token: Column, letters: dict[str, str]) -> Column:
    """Letter by letter through a map, unknown ones as they are."""
    table = F.create_map(*(F.lit(x) for pair in letters.items() for x in pair))
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, F.upper(c)), c)), " ")


def script_share(text: Column, script: str = OTHER_SCRIPT) -> Column:
    """The share of a script's characters among those outside code that are no white space, to four places; 0 for a blank text."""
    bare = F.regexp_replace(without_code(text), r"(?U)[\s\x1c-\x1f]+", "")
    return let(bare, lambda b: F.round(F.length(F.regexp_replace(b, f"[^{script}]", "")) / F.greatest(F.length(b), F.lit(1)), 4))


def mix_penalty(text: Column, script: str = OTHER_SCRIPT) -> Column:
    """Latin words of four letters or more outside code for each eight characters of the script, at most 1; 1 without any such
    character; to four places."""
    def share(bare: Column) -> Column:
        own = F.length(F.regexp_replace(bare, f"[^{script}]", ""))
        words = F.regexp_count(bare, F.lit(f"{BEFORE}[A-Za-z]{{4,}}+{AFTER}"))
        return F.when(own == 0, F.lit(1.0)).otherwise(F.round(F.least(words / F.greatest(own / 8, F.lit(1.0)), F.lit(1.0)), 4))

    return let(without_code(text), share)


def ends_with(text: Column, mark: str = "။") -> Column:
    return F.endswith(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit(mark))


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


#: Fixed patterns: a row, a row of dashes, and what parts two rows on one line.
_ROW, _DASHES = r"\|[^|\n]+(?:\|[^|\n]+)+\|", r"\|[-:\s|]+\|"


def table_repaired(text: Column) -> Column:
    """Line breaks put back into markdown tables whose rows stand on one line: before and after the dashes, then between rows."""
    steps = ((rf"(?U)({_ROW})\s+({_DASHES})", "$1\n$2"), (rf"(?U)({_DASHES})\s+({_ROW})", "$1\n$2"), (rf"(?U)({_ROW})\s+(?=\|[^|\n-])", "$1\n"))
    return F.when(F.contains(text, F.lit("|")), reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)).otherwise(text)


def generated_title(title: Column, most: int = 80) -> Column:
    """What a model says a title is, without quotes around it and a full stop, cut; "New chat" if nothing is left."""
    bare = strip(F.regexp_replace(strip(F.coalesce(title, F.lit(""))), "^[\"']+|[\"']+\\z", ""))
    body = let(bare, lambda t: F.when(F.endswith(t, F.lit(".")), strip(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t))
    return let(body, lambda t: F.when(t == "", "New chat").otherwise(clipped(t, most)))


#: What Python's splitlines and a Spark user's eye take for the end of a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def session_title(text: Column, most: int = 80) -> Column:
    """The first line, or the file name of an upload note; "New chat" for a blank text."""
    first = strip(F.split(strip(F.coalesce(text, F.lit(""))), LINE_END)[0])
    named = F.when(F.lower(first).startswith('uploaded "'), strip(F.regexp_replace(F.substring(first, 11, 1 << 30), '"\\z', ""))).otherwise(first)
    return F.when(named == "", "New chat").otherwise(clipped(named, most))


def profile_title(text: Column, canonical: Column, asks_who: Column, most: int = 80) -> Column:
    """A title by the matched profile: who is asked about, or the fallback if it has the surname; null without a profile."""
    surname = F.lower(F.element_at(F.split(strip(canonical), r"\s+"), -1))
    plain = session_title(text, most)
    return F.when(asks_who, clipped(F.concat(F.lit("Who is "), canonical), most)).when(F.contains(F.lower(plain), surname) & (plain != "New chat"), plain)


def corrected_title(title: Column, text: Column, canonical: Column, asks_who: Column, most: int = 80) -> Column:
    """A generated title that does not have the surname of the text's profile gives way to the rule's."""
    surname = F.lower(F.element_at(F.split(strip(canonical), r"\s+"), -1))
    right = canonical.isNull() | F.contains(F.lower(title), surname)
    return F.when(right, title).otherwise(F.coalesce(profile_title(text, canonical, asks_who, most), clipped(F.concat(F.lit("Who is "), canonical), most)))


def content_key(*parts: Column, length: int = 64) -> Column:
    """The leading hex digits of the SHA-256 of the parts, joined by newlines."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, length)


def unfenced(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    return strip(F.regexp_replace(strip(F.coalesce(reply, F.lit(""))), r"(?i)\A```(?:json)?\s*|\s*```\z", ""))


def route_of_reply(reply: Column, routes: Sequence[str]) -> Column:
    """A model's route: the field of a JSON object, or for what is not JSON the first token bare of marks at its ends; null
    if unknown, and for JSON that is no object."""
    body = unfenced(reply)
    parsed = F.try_parse_json(body)
    field = F.lower(strip(F.get_json_object(body, "$.route")))
    token = F.regexp_replace(F.lower(F.split(body, r"(?U)\s+")[0]), r"\A[\"{}:,]+|[\"{}:,]+\z", "")
    route = F.when(parsed.isNull(), token).when(F.schema_of_variant(parsed).startswith("OBJECT"), field)
    return F.when(route.isin(*routes), route)


def voice(message: Column, content: Column, session: Column, markers: dict[str, Sequence[str]]) -> Column:
    """What the message says, else what its first-person markers tell, else the session's."""
    told = F.coalesce(*(F.when(contains_any(content, hints), F.lit(name)) for name, hints in markers.items()), F.lit(None))
    return F.coalesce(F.nullif(message, F.lit("")), told, session)


#: Forms in which services say what went wrong.
QUOTA = ("429", "resource_exhausted", "resource exhausted", "resourceexhausted", "quota", "rate limit", "rate_limit", "too many requests")
OVERLOAD = ("503", "unavailable", "high demand", "overloaded")
MISSING = ("(404)", "not_found", "not found")


def is_quota(message: Column) -> Column:
    return contains_any(message, QUOTA)


def is_overload(message: Column, code: Column) -> Column:
    """By the words, or by a status of the server's side other than "not implemented"."""
    return contains_any(message, OVERLOAD) | F.coalesce((code >= 500) & (code < 600) & (code != 501), F.lit(False))


def is_missing(message: Column) -> Column:
    return contains_any(message, MISSING)


def retry_delay(message: Column, attempt: Column, quota: Column, overload: Column | None = None) -> Column:
    """Seconds to wait: what a quota's message asks and one more, 50 without it; for an overload five, doubling up to 30;
    else one, doubling up to 60."""
    asked = F.regexp_extract(F.lower(message), r"retry in ([0-9.]+)s", 1).try_cast("double") + 1
    slow = F.least(5 * F.pow(F.lit(2.0), attempt), F.lit(30.0))
    return F.when(quota, F.coalesce(asked, F.lit(50.0))).when(F.lit(False) if overload is None else overload, slow).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(60.0)))
