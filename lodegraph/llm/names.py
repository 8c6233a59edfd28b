"""Names of people and organisations typed in many ways.

Every name is rewritten into all canonical forms that rules allow: token orders and
cuts, titles and particles, nicknames, typing errors, short forms and initials for people;
order, legal forms, abbreviations and numbering for organisations. The rewritings are
exploded and joined on the form. A rewriting is scored by its rarity: the fewer forms a
rule gives for a word, the more it says, and a name takes the form that the rewritings of
all its namesakes make likeliest. Which words are given names, and what each may stand for,
is learnt from the names themselves and is a table like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm import spelling
from lodegraph.session import materialize

# Lines of business, those of them that are also abbreviated first, and
# abbreviations that no rule below yields.
LINES = (
    "fund", "properties", "holdings", "ventures", "trading", "management", "consulting", "marine", "textiles", "logistics", "services", "capital",
    "shipping", "nominees", "resources", "investments", "aviation", "international",
)
MORE_LINES = (
    "partners", "industries", "enterprises", "group", "finance", "energy",
    "minerals", "estates", "securities", "technologies", "associates", "development", "equities", "brokers", "commodities", "insurance", "agency", "advisors",
)
LINE_SHORT = {"fd": "fund", "fnd": "fund", "int": "international", "intl": "international", "invs": "investments", "inv": "investments", "res": "resources", "cons": "consulting", "mgt": "management", "man": "management", "holding": "holdings", "svc": "services", "mar": "marine", "avn": "aviation"}
# Legal forms as written, without dots and spaces.
LEGAL = {
    "sa": "sa", "socanon": "sa", "llc": "llc", "gmbh": "gmbh", "gesellschaftmbh": "gmbh", "bv": "bv", "foundation": "foundation", "found": "foundation", "fdn": "foundation",
    "fndn": "foundation", "fndtn": "foundation", "corporation": "corp", "corp": "corp", "limited": "ltd", "ltd": "ltd", "lim": "ltd", "incorporated": "inc", "inc": "inc",
    "incorp": "inc", "trust": "trust", "trst": "trust", "tr": "trust", "plc": "plc", "ag": "ag", "nv": "nv",
}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "hon", "capt", "adv", "sir", "dame", "rev", "lord", "lady", "esq", "col", "maj", "lt", "gen", "mx", "eng", "atty"}
REMARKS = {"deceased", "jr", "sr", "nominee", "as", "trustee", "executor", "the", "retd", "ii", "iii"}
PARTICLES = {"van", "de", "al", "der", "den", "von", "la", "le", "du", "di", "da", "del", "el", "bin", "ibn", "dos", "ter", "ten", "zu", "st"}
_LONG_PARTICLES = ("van", "von", "der", "den", "del", "dos", "bin", "ibn")
# Usual short forms that no rule below yields, beside those of the table given.
MORE_NICKS = {
    "ned": ("edward",), "ed": ("edward",), "maggie": ("margaret",), "peg": ("margaret",), "klaus": ("nicholas",), "kate": ("katherine",), "katie": ("katherine",), "bob": ("robert",), "bert": ("albert",),
    "jack": ("john",), "harry": ("harold", "henry"), "hank": ("henry",), "dolly": ("dorothea",), "dot": ("dorothea",), "dottie": ("dorothea",), "molly": ("mary",), "polly": ("penelope",), "penny": ("penelope",), "nelly": ("penelope",),
    "zak": ("zachary",), "zack": ("zachary",), "billy": ("william",), "bobby": ("robert",), "sasha": ("alexander",), "xander": ("alexander",), "sander": ("alexander",), "lena": ("helena",), "greta": ("margaret",), "rita": ("margaret",),
    "lizzie": ("elizabeth",), "libby": ("elizabeth",), "bess": ("elizabeth",), "eliza": ("elizabeth",), "lisa": ("elizabeth",), "bee": ("beatrice",), "trixie": ("beatrice",), "gus": ("augustus",), "paddy": ("patricia",), "patsy": ("patricia",), "patty": ("patricia",),
    "lonnie": ("lawrence",), "laurie": ("lawrence",), "cissy": ("francesca",), "frank": ("francesca", "frederick"), "dickie": ("richard",), "ricky": ("richard",), "rich": ("richard",), "teddy": ("edward", "theodore"), "jonno": ("jonathan",), "nate": ("nathaniel",), "nat": ("nathaniel",),
    "wendy": ("gwendolyn",), "winnie": ("winifred",), "fred": ("frederick", "winifred"), "vic": ("victoria",), "tori": ("victoria",), "barty": ("bartholomew",), "tolly": ("bartholomew",), "iggy": ("ignatius",), "etta": ("henrietta",), "harriet": ("henrietta",), "carlotta": ("charlotte",),
    "chuck": ("charles",), "topher": ("christopher",), "kester": ("christopher",), "josh": ("joshua",), "posy": ("josephine",), "fina": ("josephine",), "ike": ("isaac",), "belle": ("isabella",), "ibby": ("isabella",), "gail": ("abigail",), "quin": ("quentin",), "quinn": ("quentin",), "len": ("leonard",), "lenny": ("leonard",),
}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15}
_INNER = re.compile(r"(?<=\w)['’`](?=\w)")
_SPACED = (
    (re.compile(r"\bgesellschaft\s+m\.?\s?b\.?\s?h\b\.?"), " gmbh "), (re.compile(r"\bsoc\.?\s*anon\b\.?"), " socanon "), (re.compile(r"\bg\.\s?m\.\s?b\.\s?h\b\.?"), " gmbh "), (re.compile(r"\bl\.\s?l\.\s?c\b\.?"), " llc "),
    (re.compile(r"\bb\.?\s?v\b\.?"), " bv "), (re.compile(r"\bs\.?\s?a\b\.?"), " sa "), (re.compile(r"\bl\s?l\s?c\b"), " llc "), (re.compile(r"\bg\s?m\s?b\s?h\b"), " gmbh "),
)
_SPACED_OUT = ({"s", "a"}, {"b", "v"}, {"l", "c"}, {"g", "m"})
_FIRM_WORDS = {k for k in LEGAL if k not in ("sa", "bv", "tr", "ag", "nv", "lim")} | set(LINES) | set(MORE_LINES)


_NEAR_LINES, _NEAR_LEGAL = spelling.Near(LINES + MORE_LINES), spelling.Near(k for k in LEGAL if len(k) >= 6)


def _letters_in_order(short: str, word: str) -> bool:
    it = iter(word)
    return short[0] == word[0] and all(c in it for c in short)


@lru_cache(1 << 16)
def line_of(word: str) -> str | None:
    """The line of business that a word stands for, abbreviations and single typing errors included."""
    if word in LINES or word in MORE_LINES:
        return word
    if word in LINE_SHORT:
        return LINE_SHORT[word]
    if word in LEGAL or word in TITLES or word in REMARKS or len(word) < 3:
        return None
    if begin := [x for x in LINES if x.startswith(word)]:
        return begin[0] if len(begin) == 1 or len(word) >= 3 else None
    if len(word) <= 8 and (hits := [x for x in LINES if _letters_in_order(word, x) and not set(word[1:]) <= set("aeiou")]) and not _pronounceable(word):
        return min(hits, key=len)
    return next(iter(_NEAR_LINES.find(word)), None) if len(word) >= 5 else None


def _pronounceable(word: str) -> bool:
    """Whether a third of the letters are vowels, as in a name and not in an abbreviation."""
    return sum(c in "aeiouy" for c in word) * 3 >= len(word)


@lru_cache(1 << 16)
def legal_of(word: str) -> str | None:
    if word in LEGAL:
        return LEGAL[word]
    return LEGAL[near[0]] if len(word) >= 5 and (near := _NEAR_LEGAL.find(word)) else None


def series_of(word: str) -> int | None:
    return _ROMAN.get(word, int(word) if word.isdigit() and len(word) < 6 else None)


_TOKEN = re.compile(r"[^\W_]+")


@lru_cache(1 << 18)
def _firm_like(word: str) -> bool:
    word = spelling.unscan(word)
    return legal_of(word) is not None or line_of(word) is not None


def organisation(name: str) -> dict | None:
    """Core, line, number and legal form of an organisation's name; None if it isn't one."""
    s = _INNER.sub("", spelling.plain(name))
    tokens = _TOKEN.findall(s)
    single = {t for t in tokens if len(t) == 1}
    spaced = any(x <= single for x in _SPACED_OUT) or "gesellschaft" in s or "soc" in s
    # Most names are people's: none of their words can be a form or a line.
    if not spaced and not any(map(_firm_like, tokens)):
        return None
    for pattern, to in _SPACED if spaced else ():
        s = pattern.sub(to, s)
    tokens = [spelling.unscan(t) if not t.isdigit() else t for t in (_TOKEN.findall(s) if spaced else tokens)]
    core, line, number, legal, firm = [], None, None, None, False
    for t in tokens:
        if t in ("the", "no", "nr", "number", "and", "of", "co"):
            continue
        if legal is None and (x := legal_of(t)):
            legal, firm = x, firm or t in _FIRM_WORDS or len(t) > 4
        elif (x := line_of(t)) and line is None and len(tokens) > 1:
            line, firm = x, True
        elif (x := series_of(t)) is not None and number is None and (line or len(t) > 1 or t.isdigit()):
            number = x
        else:
            core.append(t)
    if not firm or not core or (line is None and legal is None):
        return None
    return {"core": "".join(core), "line": line or "", "number": -1 if number is None else number, "legal": legal or ""}


@lru_cache(1 << 16)
def particle(word: str) -> bool:
    """Whether a word is a particle, with scanned digits or a letter doubled, dropped or swapped."""
    if word in PARTICLES or word.translate(spelling.SCANNED) in PARTICLES:
        return True
    return len(word) <= 4 and any(word[0] == p[0] and set(word) <= set(p) and spelling.within(word, p, 1) for p in _LONG_PARTICLES)


@lru_cache(1 << 16)
def _dropped(word: str) -> bool:
    return word in TITLES or word in REMARKS or particle(word)


def person_tokens(name: str) -> tuple[list[str], list[str]]:
    """The words of a person's name: those before a comma (none without one), and the rest.

    Titles, remarks, particles and what stands in brackets are left out.
    """
    s = _INNER.sub("", spelling.plain(name))
    if "(" in s:
        s = re.sub(r"\([^)]*\)?", " ", s)
    if "-" in s:
        # A hyphen joins the halves of one name, but not a particle and its name.
        s = re.sub(r"\b(al|el)-", r"\1 ", s)
        s = re.sub(r"(?<=\w\w)-(?=\w)", "", s)
    before, comma, after = s.partition(",")
    clean = lambda x: [spelling.unscan(t) for t in _TOKEN.findall(x) if not _dropped(t)]
    a, b = clean(before), clean(after)
    return (a, b) if comma and a and b else ([], a + b)


#: How a reading's chance follows from how many names its words open.
SURE, OPENED, INITIALS, FRONT, BACK, LAST, KNOWN, UNKNOWN = range(8)
_FIELDS = ("rest", "core", "sig", "first", "middle", "way", "factor", "lead", "tail", "inner", "given", "family")
_TYPES = ("string", "string", "string", "string", "string", "int", "double", "string", "string", "array<string>", "string", "array<string>")
_READ = f"id long, name string, readings array<struct<{', '.join(f'{f}:{t}' for f, t in zip(_FIELDS, _TYPES, strict=True))}>>"


def _reading(given: list[str], family: list[str]) -> tuple[str, str, str]:
    """Core, first given name (or initial) and middle initial."""
    full = [t for t in given if len(t) > 1]
    first = full[0] if full else (given[0] if given else "")
    middle = next((t for t in given[given.index(first) + 1 :] if len(t) == 1), "") if first else ""
    return "".join([t for t in family if len(t) > 1] or family), spelling.short_id(first), middle


def _cuts(words: list[str]) -> list[tuple[list[str], list[str], int, float, list[str]]]:
    """Every way to read the words of a name without a comma: given names, family name, way, factor, and words that must be given names.

    Both orders, and with words in the middle also the cut behind them, if those turn
    out to be given names. An initial that opens a name belongs to the given names.
    """
    full = [i for i, t in enumerate(words) if len(t) > 1]
    if not full:
        return [(words[:-1], words[-1:], SURE, 1.0, [])]
    first, last = full[0], full[-1]
    if first == last:
        if first:
            return [(words[:first], words[first:], SURE, 1.0, [])]
        return [(words[:-1], words[-1:], KNOWN, 1.0, []), (words[1:], words[:1], UNKNOWN, 1.0, [])]
    ahead = first + 1
    while ahead < last and len(words[ahead]) == 1:
        ahead += 1
    inner = [t for t in words[first + 1 : last] if len(t) > 1]
    front = 3.0 if first > 0 or ahead > first + 1 else 1.0
    ends = words[last + 1 :]
    way = OPENED if first else FRONT
    ways = [(words[:ahead] + ends, words[ahead : last + 1], way, front, [])]
    if first:  # nothing but initials, and a family name in several words
        ways.append((words[:first] + ends, words[first : last + 1], INITIALS, 3.0, []))
    if inner:
        ways.append((words[:last] + ends, words[last : last + 1], way, front, inner))
    if first == 0:
        back = 3.0 if ends else 1.0
        ways.append((words[last:], words[:last], BACK, back, []))
        if inner:
            ways.append((words[1:], words[:1], BACK, back, inner))
        if ends:  # a family name in two words, and an initial
            ways.append((ends, words[: last + 1], LAST, 0.4, []))
    return ways


def readings(text: str) -> tuple[str, list[tuple]]:
    """A name without what does not matter, and all its readings: the fields of ``_FIELDS``.

    The core is the family name or the organisation's own words, written together; the
    rest is what must agree as well: kind, line and number. Where the words stand tells
    which open names and which close them: the last two fields, of the first reading only.
    """
    if firm := organisation(text):
        form = f"{firm['line']}|{firm['number']}"
        return f"o {firm['core']}|{form}", [("o", firm["core"], form, form, "", SURE, 1.0, None, None, None, None, None)]
    family, words = person_tokens(text)
    name = f"p {' '.join(family)}, {' '.join(words)}"
    if family:
        core, first, middle = _reading(words, family)
        return name, [("p", core, f"{first}|{middle}", first, middle, SURE, 1.0, None, None, None, words[0], family)]
    if len(words) < 2:
        return name, [("p", words[0], "|", "", "", SURE, 1.0, None, None, None, None, None)] if words and len(words[0]) > 1 else []
    full = [spelling.short_id(t) for t in words if len(t) > 1] or [None]
    outer = full[0], full[-1]
    out: dict[tuple, tuple] = {}
    for given, family, way, factor, inner in _cuts(words):
        core, first, middle = _reading(given, family)
        evidence = (words[0], words[-1:]) if not out else (None, None)
        out.setdefault((core, first, middle), ("p", core, f"{first}|{middle}", first, middle, way, factor, *outer, [spelling.short_id(t) for t in inner] or None, *evidence))
    return name, list(out.values())


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        read = [readings(v) for v in pdf["value"]]
        yield pd.DataFrame({"id": pdf["id"], "name": [n for n, _ in read], "readings": [[dict(zip(_FIELDS, r, strict=True)) for r in rs] for _, rs in read]})


def read_names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id`` with ``name``, and each name once with ``n``, how many records have it, and a row for each of its readings; ``rows`` has ``id`` and ``value``."""
    read = materialize(rows.mapInPandas(_read, _READ).filter("size(readings) > 0"), "read")
    once = read.groupBy("name").agg(F.count("*").alias("n"), F.first("readings").alias("readings"))
    return read.select("id", "name"), materialize(once.select("name", "n", F.inline("readings")), "readings")


#: Typing errors and short forms of a given name are so many times rarer than the name.
RARER = 3
#: A word that opens so many names is a given name beside one that opens none: then their order is certain.
CERTAIN = 8
#: A short form may be the middle of given names of so many letters at most, and the beginning of any that is written out.
SHORTENED = 24


def _nicks(nicknames: DataFrame) -> DataFrame:
    """``nick`` and ``formal``, cleaned, with the usual ones that no rule yields; at most 100,000 rows."""
    rows = [(r.nick, r.formal) for r in nicknames.select("nick", "formal").dropna().distinct().limit(100_001).collect()]
    if len(rows) > 100_000:
        raise ValueError("the table of nicknames is too large to send to every executor")
    rows += [(n, f) for n, fs in MORE_NICKS.items() for f in fs]
    pairs = sorted({(spelling.plain(n), spelling.plain(f)) for n, f in rows if n and f})
    return nicknames.sparkSession.createDataFrame(pairs, "nick string, formal string")


def _stems(word: Column) -> Column:
    """What the given name may begin or end with, or hold, that ``word`` is a short form of."""
    bare = F.regexp_replace(word, "(?:ie|ey|y|i|o|a|e|s)$", "")
    once = lambda c: F.regexp_replace(c, r"(.)\1$", "$1")
    plain = F.array(word, bare, once(word), once(bare))
    hard = F.transform(F.filter(plain, lambda c: c.endswith("k")), lambda c: F.concat(c.substr(F.lit(1), F.length(c) - 1), F.lit("c")))
    return F.filter(F.array_distinct(F.concat(plain, hard)), lambda c: F.length(c) >= 2)


def _parts(formal: Column) -> Column:
    """All pieces of a given name of four letters or more, and its beginnings and ends of two and three."""
    n = F.length(formal)
    inside = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(4), F.greatest(n - i + 1, F.lit(4))), lambda k: formal.substr(i, k))))
    ends = F.array(formal.substr(1, 2), formal.substr(1, 3), F.when(n >= 3, formal.substr(n - 2, F.lit(3))))
    return F.filter(F.array_distinct(F.concat(ends, F.when(n <= SHORTENED, inside).otherwise(F.array(formal)))), lambda c: c.isNotNull() & (F.length(c) >= 2))


def _short_of(words: DataFrame, formal: DataFrame) -> DataFrame:
    """``word``, ``form``, ``rule``: the given names that a word is a beginning or end of (3), or else a middle (4)."""
    asked = words.filter("word = letters").select("word", F.explode(_stems(F.col("word"))).alias("key"))
    held = formal.filter("word = letters").select(F.col("word").alias("form"), F.explode(_parts(F.col("word"))).alias("key"))
    found = asked.join(held, "key").filter("word <> form")
    n, k = F.length("word"), F.length("key")
    begins = F.col("form").startswith(F.col("key")) & ((k >= 3) | (n > 3))
    ends = (F.col("key") == F.col("word")) & F.col("form").endswith(F.col("key"))
    rule = F.when(begins | (ends & (n > 3)), 3).when((k >= 4) | (ends & (n >= 3)), 4)
    return found.select("word", "form", rule.alias("rule")).filter("rule is not null")


def _near(word: Column, form: Column) -> Column:
    """One edit or a moved letter apart; two edits where the form is longer than seven letters. Both share a cut of one letter each."""
    moved = (F.length(word) == F.length(form)) & (F.sort_array(F.split(word, "")) == F.sort_array(F.split(form, "")))
    return (F.length(form) > 7) | (F.levenshtein(word, form, 1) >= 0) | moved


def _typo_of(words: DataFrame, formal: DataFrame) -> DataFrame:
    """``word``, ``form``, ``rule`` 2: the given names that a word of four letters or more is a typing error of."""
    asked = spelling.with_cuts(words.filter("length(word) >= 4").select("word", "letters"), "letters", "key")
    held = spelling.with_cuts(formal.select(F.col("word").alias("form"), "letters"), "letters", "key")
    found = asked.join(held, "key").filter((F.col("word") != F.col("form")) & _near(F.col("word"), F.col("form")))
    return found.select("word", "form", F.lit(2).alias("rule"))


def given_names(read: DataFrame, nicks: DataFrame) -> DataFrame:
    """Every word that may be a given name, with what it may stand for.

    ``word``, ``opens`` (how many names it opens, itself or as what it stands for), ``known``
    (whether it is found to be one) and ``forms``: given names with the weight of the
    rewriting, 1 as written, less by the kind of rule and the more names the rule gives.

    A word is a given name if it opens more names than it closes, and several. It stands for
    itself, however rare or short, unless it follows a commoner near spelling, or is a short
    form, by the table or by the rules (a beginning, an end or a middle of the name, with
    its usual endings), of one ``RARER`` times as common. Then it stands for those, as do
    words that are no given names: by nickname, else by typing error, else by short form,
    else by a nickname's typing error, else for itself.
    """
    people = read.filter("rest = 'p'")
    stands = lambda c, g, f: people.select(F.explode(c).alias("letters") if c == "family" else F.col(c).alias("letters"), F.lit(g).alias("g"), F.lit(f).alias("f"))
    others = F.concat(F.array("first", "lead", "tail"), F.coalesce("inner", F.array().cast("array<string>")))
    other = people.filter("way > 0").select(F.explode(others).alias("letters"), F.lit(0).alias("g"), F.lit(0).alias("f"))
    seen = stands("given", 1, 0).union(stands("family", 0, 1)).union(other).filter("length(letters) > 1")
    # Long words go by what stands for them; their letters are kept for their typing errors.
    letters = F.when(~F.col("letters").startswith("\x02"), F.col("letters"))
    words = seen.withColumn("word", spelling.short_ids(F.col("letters"))).groupBy("word").agg(F.sum("g").alias("g"), F.sum("f").alias("f"), F.max(letters).alias("letters"))
    words = materialize(words.withColumn("letters", F.coalesce("letters", "word")), "words")
    counts = words.filter("g >= 2 and g > f").select("word", "letters", "g")
    usual = spelling.cluster_spellings(counts.withColumn("kind", F.lit("g")), ["kind"], "letters", "g", ratio=RARER)
    usual = usual.filter(F.col("canonical") == spelling.short_ids(F.col("letters"))).select(F.col("canonical").alias("word"), F.lit(True).alias("own"))
    named = nicks.select(F.col("formal").alias("word")).distinct().withColumn("named", F.lit(True))
    short = nicks.select(F.col("nick").alias("word")).distinct().withColumn("nick", F.lit(True))
    small = lambda df: F.broadcast(df)  # noqa: E731 - nicknames, bounded when they are read
    known = counts.join(usual, "word", "left").join(small(named), "word", "left").join(small(short), "word", "left")
    first = materialize(known.filter("named or (own and nick is null)").select("word", "letters", "g", F.coalesce("named", F.lit(False)).alias("named")), "givens")
    by = first.select(F.col("word").alias("form"), F.col("g").alias("g_form"))
    gone = _best_rule(_short_of(first.filter("not named"), first)).join(by, "form").join(first.select("word", "g"), "word").filter(F.col("g_form") >= RARER * F.col("g"))
    formal = materialize(first.join(gone.select("word").distinct(), "word", "left_anti").select("word", "letters", "g"), "givens")
    rest = words.join(formal, "word", "left_anti").select("word", "letters")
    table = rest.join(small(nicks), rest.word == nicks.nick).select("word", "formal").join(formal.select(F.col("word").alias("formal"), F.lit(True).alias("real")), "formal", "left")
    # A nickname stands for the given names that occur, or for all it has if none does.
    table = table.select("word", F.col("formal").alias("form"), F.when(F.col("real"), 0).otherwise(1).alias("rule"))
    nicked = nicks.filter("length(nick) > 3").select(F.col("nick").alias("word"), "formal")
    wrong = _typo_of(rest, nicked.select("word", F.col("word").alias("letters")).distinct()).join(small(nicked.withColumnRenamed("word", "form")), "form").filter((F.levenshtein("word", "form", 1) >= 0) | (F.length("word") == F.length("form")))
    wrong = wrong.select("word", F.col("formal").alias("form"), F.lit(5).alias("rule"))
    every = table.union(_typo_of(rest, formal)).union(_short_of(rest, formal)).union(wrong)
    best = _best_rule(every)
    on = best.join(formal.select(F.col("word").alias("form"), F.col("g").alias("g_form")), "form", "left")
    weight = F.element_at(F.array(*[F.lit(x) for x in (0.8, 0.8, 0.9, 0.6, 0.6, 0.5)]), F.col("rule") + 1) / F.col("k")
    on = on.withColumn("k", F.count("*").over(Window.partitionBy("word")))
    forms = on.groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("form", weight.alias("weight")))).alias("forms"), F.max(F.when(F.col("rule") <= 1, 1 + F.coalesce("g_form", F.lit(0)))).alias("as_nick"),
        F.max(F.when(F.col("rule") == 2, F.col("g_form"))).alias("as_typo"), F.min("rule").alias("rule"))
    itself = F.array(F.struct(F.col("word").alias("form"), F.lit(1.0).alias("weight")))
    out = words.join(forms, "word", "left").join(counts.select("word", F.col("g").alias("own")), "word", "left")
    opens = F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("as_nick", F.lit(0))).cast("double")
    return materialize(out.select(
        "word", F.when(opens > 0, opens).otherwise(0.5 * F.coalesce("as_typo", F.lit(0))).alias("opens"),
        (F.col("own").isNotNull() | F.coalesce(F.col("rule") <= 2, F.lit(False))).alias("known"), F.coalesce("forms", itself).alias("forms")), "given")


def _best_rule(found: DataFrame) -> DataFrame:
    """Of each word the forms by its first rule that gives any."""
    w = Window.partitionBy("word")
    return found.distinct().withColumn("_least", F.min("rule").over(w)).filter("rule = _least").select("word", "form", "rule")


def weighed(read: DataFrame, given: DataFrame) -> DataFrame:
    """``name``, ``n``, ``rest``, ``core``, ``sig``, ``initial``, ``middle``, ``forms``, ``chance``: the readings that are possible.

    A reading whose given name opens no name, beside a word that opens ``CERTAIN`` or more,
    is left out; the others share the name's chance by how many names their given names
    open, and where initials stand.
    """
    of = lambda c: given.select(F.col("word").alias(c), F.col("opens").alias(f"{c}_opens"), F.col("known").alias(f"{c}_known"))
    inner = read.filter("inner is not null")
    asked = inner.select("name", "core", "sig", F.explode("inner").alias("word")).join(given.select("word", "opens"), "word", "left")
    asked = asked.groupBy("name", "core", "sig").agg(F.min(F.coalesce("opens", F.lit(0.0))).alias("least")).filter(F.col("least") >= CERTAIN)
    rows = read.filter("inner is null").unionByName(inner.join(asked.drop("least"), ["name", "core", "sig"], "left_semi"))
    sure = rows.filter(F.col("way") == SURE).withColumn("weight", F.lit(1.0))
    open_ = rows.filter(F.col("way") != SURE).join(of("lead"), "lead", "left").join(of("tail"), "tail", "left")
    lead, tail = F.coalesce("lead_opens", F.lit(0.0)), F.coalesce("tail_opens", F.lit(0.0))
    # An initial before the first full word settles that the given names stand in front.
    front = (F.col("way") == OPENED) | ((F.col("way") == FRONT) & ~((tail >= CERTAIN) & (lead == 0)))
    back = F.col("way").isin(BACK, LAST) & ~((lead >= CERTAIN) & (tail == 0))
    named = F.coalesce("lead_known", F.lit(False))
    weight = F.when(F.col("way") == INITIALS, F.col("factor")).when(front, F.col("factor") * (lead + 0.6)).when(back & (F.col("way") == BACK), F.col("factor") * (tail + 0.4)).when(back, F.col("factor"))
    # A word and an initial: family name and given name, or the other way round if the word is found to be a given name.
    weight = F.coalesce(weight, F.when((F.col("way") == KNOWN) & named, lead + 0.6).when(F.col("way") == UNKNOWN, 1.0))
    both = sure.unionByName(open_.withColumn("weight", weight).filter("weight is not null").select(*sure.columns))
    forms = F.when(F.length("first") > 1, F.col("forms"))
    own = F.array(F.struct(F.when(F.col("rest") == "o", F.col("sig")).otherwise(F.col("first")).alias("form"), F.lit(1.0).alias("weight")))
    initial = (F.col("rest") == "p") & (F.length("first") == 1)
    both = both.join(given.select(F.col("word").alias("first"), "forms"), "first", "left")
    return both.select(
        "name", "n", "rest", "core", "sig", initial.alias("initial"), "middle", F.coalesce(F.when(F.col("rest") == "p", forms), own).alias("forms"),
        (F.col("weight") / F.sum("weight").over(Window.partitionBy("name"))).alias("chance"))


def _with_initials(each: DataFrame, by: list[str]) -> DataFrame:
    """``each`` with the forms that an initial may stand for: all that other names of the same ``by`` have and it opens.

    An initial that opens none keeps one row, itself as the form. There is one row here for
    each way to write a given name in a family, so at most 702 are initials.
    """
    at = F.substring("form", 1, 1)
    open_ = each.filter(~F.col("initial")).select(*by, "form", at.alias("_at")).distinct()
    short = each.filter("initial").withColumnRenamed("form", "_at").join(open_, [*by, "_at"], "left")
    short = short.withColumn("form", F.coalesce("form", "_at"))
    return each.filter(~F.col("initial")).unionByName(short.drop("_at"))


_SIG = ["rest", "canonical", "sig"]
_FORM = ["rest", "canonical", "form"]


def _support(each: DataFrame) -> DataFrame:
    """How much the rewritings of full given names speak for each form: names times rarity."""
    return each.groupBy(*_FORM).agg(
        F.round(F.sum(F.when(~F.col("initial"), F.col("n") * F.col("weight")).otherwise(0.0)), 6).alias("support"),
        F.collect_set(F.when(~F.col("initial") & (F.col("middle") != ""), F.col("middle"))).alias("middles"))


def resolved_names(entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``id``, ``rest``, ``canonical``, ``who``: the name of each record of domains 0 to 2; equal columns are one name."""
    ids, read = read_names(spelling.ids_and_values(entities, [0, 1, 2], ["entity", "officer", "intermediary"], ["name"]))
    given = given_names(read, _nicks(nicknames))
    # A particle written onto the family name: the name without it is one more key.
    bare = lambda w: F.array(*[F.when(w.startswith(p) & (F.length(w) >= len(p) + 6), F.substring(w, len(p) + 1, 1 << 30)) for p in ("al", "de", "van")])
    forms = materialize(weighed(read, given), "weighed")
    cores = forms.groupBy("rest", "core").agg(F.round(F.sum(F.col("n") * F.col("chance")), 6).alias("n"))
    usual = spelling.cluster_spellings(cores, ["rest"], "core", "n", more=bare)
    forms = materialize(forms.join(usual, ["rest", "core"]), "forms")
    # Names of one signature are one row from here on, however many records have them.
    sigs = forms.groupBy(*_SIG).agg(F.sum(F.col("n") * F.col("chance")).alias("n"), F.first("forms").alias("forms"), F.first("initial").alias("initial"), F.first("middle").alias("middle"))
    each = sigs.select(*_SIG, "n", "initial", "middle", F.inline("forms"))
    each = materialize(_with_initials(each, ["rest", "canonical"]), "rewritten")
    likely = each.join(_support(each), _FORM).groupBy(*_SIG).agg(F.max("support").alias("likely"))
    # One reading for each name: the one that most records, by all readings of their names, support.
    # Of equal support all names take the same reading, whatever their own order.
    unsure = forms.filter("chance < 1").join(likely, _SIG)
    best = F.max(F.struct("likely", "core", "chance", "sig", "rest", "canonical", "n")).alias("b")
    chosen = unsure.groupBy("name").agg(best).select("name", "b.rest", "b.canonical", "b.sig", "b.n")
    chosen = materialize(forms.filter("chance >= 1").select("name", *_SIG, "n").unionByName(chosen), "chosen")
    held = chosen.groupBy(*_SIG).agg(F.sum("n").cast("double").alias("n"))
    each = materialize(each.drop("n").join(held, _SIG), "rewritten")
    seen = each.join(_support(each), _FORM)
    fits = F.array_contains("middles", F.col("middle")) & (F.col("middle") != "")
    w = Window.partitionBy(*_SIG)
    seen = seen.withColumn("fits", fits & F.col("initial")).withColumn("score", F.round(F.col("support") * F.col("weight"), 9))
    ranked = seen.withColumn("r", F.row_number().over(w.orderBy(F.desc("fits"), F.desc("score"), "form"))).withColumn(
        "rivals", F.sum((F.col("support") > 0).cast("int")).over(w)).withColumn("fitting", F.sum(F.col("fits").cast("int")).over(w))
    sure = ~F.col("initial") | (F.col("rivals") == 1) | (F.col("fitting") == 1)
    best = ranked.filter("r = 1").select(*_SIG, F.when(sure, F.col("form")).otherwise(F.concat(F.lit("?"), "sig")).alias("who"))
    return ids.join(chosen.select("name", *_SIG).join(best, _SIG), "name").select("id", "rest", "canonical", "who")


def same_name(entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b`` of records of domains 0 to 2 that name the same person or organisation.

    People agree in family name and given name, organisations in their own words, line of business and
    series number; legal forms, titles, particles and middle initials may differ or be missing. An
    initial is read as the only given name of that family that fits it, or, if several
    do, the only one with the same middle initial; otherwise it stays by itself.
    Null and empty texts, records without a name and without an id match nothing; repeats change
    nothing; further columns are ignored; an empty table gives no pairs. ``nicknames``
    is a small table, read whole up to 100,000 rows; more are an error. A name with very many
    records has a square of pairs: ``name_classes`` says the same in one row a record.
    """
    return spelling.pairs(resolved_names(entities, nicknames), ["rest", "canonical", "who"])


def name_classes(entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``id``, ``class`` (the smallest id of the same name) and ``links`` (how many others have it), for ids with any.

    One row for each name of an id; the rest is as for ``same_name``, whose pairs are those of a class.
    """
    return spelling.classes(resolved_names(entities, nicknames), ["rest", "canonical", "who"])
