"""Surrogates for personal data, in DataFrame functions only.

Detected: e-mail and IP addresses, payment-card-like numbers, IBANs, social security numbers, telephone numbers, secrets
(long hexadecimal words and common key formats), and names after a title or a common given name. Each is replaced by a
surrogate of its type: digits by digits, letters by letters of the same case and script (Cyrillic, else Latin),
separators kept; octets by octets; card numbers and IBANs have right check digits (but for those given by rank, below); a
domain's surrogate depends on the domain alone; given names get given names of the same gender, surnames surnames, in
their script. A part of a detected name that stands alone elsewhere in the same document is a mention of it.

A surrogate is drawn by a keyed hash of type and normal form (case and separators dropped), so an entity has one surrogate
in all documents and spellings; "Mr. Smith" and "John Smith" share the surname's. Collisions are checked over the whole
corpus: a surrogate is drawn again where it equals an original of its type, one accepted earlier, or one of the same draw
whose normal form comes first. What waits after MAX_DRAWS (where originals fill much of their format's space) is given the
unused values of its format by rank; only where a format is full are surrogates longer than it, by a character at a time.

Documents without an entity aren't moved; the others are joined with their own replacements by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._spark import settle

MAX_DRAWS = 12
OPEN, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002"
_OUTSIDE = f"(?![^{OPEN}{CLOSE}]*{CLOSE})"

# Titles by gender, common given names by gender.
TITLES_M = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "господин", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "госпожа", "Госпожа")
NAMES_M = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Carlos", "José", "Juan", "Иван", "Сергей", "Дмитрий")
NAMES_F = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Sarah", "Karen", "Anna", "Laura", "Julia", "Ursula", "Sabine", "Marie", "Sophie", "Claire", "Carmen", "Lucía", "Анна", "Елена", "Ольга")
_WORD = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-]\p{L}++)*+"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


#: An IPv6 address with "::", up to seven groups beside it.
_GROUP = "[0-9A-Fa-f]{1,4}"
_COMPRESSED = "|".join([*(f"(?:{_GROUP}:){{1,{7 - n}}}(?::{_GROUP}){{1,{n}}}" for n in range(1, 7)), f"(?:{_GROUP}:){{1,7}}:", f":(?::{_GROUP}){{1,7}}"])
#: (type, pattern): the first group of a pattern is the entity. Order matters: what is marked isn't looked at again.
PATTERNS = (
    ("E", r"(?<![\p{L}\p{N}._%+-])([\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+)"),
    ("V", r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"),
    ("V", r"(?<![\p{L}\p{N}:_])(" + _COMPRESSED + r")(?![\p{L}\p{N}:_]|\.\d)"),
    ("A", r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3})(?!\.?\d)"),
    ("K", r"(?<![\p{L}\p{N}])((?=[A-Fa-f]*+\d)[A-Fa-f0-9]{32,}+|AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,})(?![\p{L}\p{N}])"),
    ("B", r"(?<![\p{L}\p{N}])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"),
    ("S", r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"),
    ("P", r"(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4})(?!\d)"),
    ("P", r"(?<![\p{L}\p{N}])((?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4})(?!\d)"),
    ("C", r"(?<![\d])(\d(?:[ -]?\d){12,18})(?!\d)"),
)
#: Each pattern needs one of these: a text without them has no entity by PATTERNS; cheap, as most texts need nothing else.
_HINT = r"[0-9@]|:[0-9A-Fa-f]{0,4}:|sk-|gh[pousr]_|AKIA"
_PEOPLE = "(?=[" + "".join(sorted({x[0] for x in TITLES_M + TITLES_F + NAMES_M + NAMES_F})) + r"])(?<!\p{L})" + _any(TITLES_M + TITLES_F + NAMES_M + NAMES_F) + r"(?!\p{L})"


def mark(rows: DataFrame) -> DataFrame:
    """The rows with their column ``text`` marked: each entity as OPEN, type, entity, CLOSE.

    Characters that serve as marks are escaped first. Each step is a projection of the one before, so that no step's
    expression is copied into the next.
    """
    rest = [c for c in rows.columns if c != "text"]
    had = F.col("text").rlike(f"[{OPEN}{CLOSE}{ESCAPE}]")
    out = F.col("text")
    for c, code in ((ESCAPE, "c"), (OPEN, "a"), (CLOSE, "b")):
        out = F.replace(out, F.lit(c), F.lit(ESCAPE + code))
    hints = F.col("text").rlike(_HINT).alias("numbers_"), F.col("text").rlike(_PEOPLE).alias("people_")
    rows = rows.select(*rest, *hints, F.when(had, out).otherwise(F.col("text")).alias("text"))
    numbers = F.col("text")
    for kind, pattern in PATTERNS:
        numbers = F.regexp_replace(numbers, pattern + _OUTSIDE, f"{OPEN}{kind}$1{CLOSE}")
    rows = rows.select(*rest, "people_", F.when(F.col("numbers_"), numbers).otherwise(F.col("text")).alias("text"))
    people = F.col("text")
    two = rf"( )({_WORD})(?!\p{{L}})"
    for kind, titles, names in (("M", TITLES_M, NAMES_M), ("F", TITLES_F, NAMES_F)):
        both = f"{OPEN}{kind}$1{CLOSE}$2{OPEN}N$3{CLOSE}"
        people = F.regexp_replace(people, rf"(?<=(?<!\p{{L}}){_any(titles)}\.?[ ])({_WORD}){two}" + _OUTSIDE, both)
        people = F.regexp_replace(people, rf"(?<![\p{{L}}{OPEN}])(?<!{OPEN}[A-Z])({_any(names)}){two}" + _OUTSIDE, both)
    people = F.regexp_replace(people, rf"(?<=(?<!\p{{L}}){_any(TITLES_M + TITLES_F)}\.?[ ])({_WORD})(?!\p{{L}})" + _OUTSIDE, f"{OPEN}N$1{CLOSE}")
    rows = rows.select(*rest, "people_", F.when(F.col("people_"), people).otherwise(F.col("text")).alias("text"))
    for kind in "MFN":  # the parts of marked names are marked wherever they stand alone
        names = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{OPEN}{kind}([^{CLOSE}]+){CLOSE}"), F.lit(1)))
        rows = rows.select(*rest, "people_", "text", F.when(F.col("people_"), names).alias("names_"))
        pattern = F.concat(F.lit(rf"(?<![\p{{L}}{OPEN}'’-])(?<!{OPEN}[A-Z])("), F.array_join("names_", "|"), F.lit(r")(?!\p{L}|['’-]\p{L})" + _OUTSIDE))
        again = F.regexp_replace(F.col("text"), pattern, F.lit(f"{OPEN}{kind}$1{CLOSE}"))
        rows = rows.select(*rest, "people_", F.when(F.size("names_") > 0, again).otherwise(F.col("text")).alias("text"))
    return rows.select(*rest, "text")


def parts(marked: Column) -> Column:
    """Text outside and type with entity in turn; the entities are at odd indices from 0."""
    return F.split(marked, f"[{OPEN}{CLOSE}]", -1)


def entities(marked: Column) -> Column:
    return F.array_distinct(F.filter(parts(marked), lambda x, i: i % 2 == 1))


def unescape(text: Column) -> Column:
    out = text
    for c, code in ((OPEN, "a"), (CLOSE, "b"), (ESCAPE, "c")):
        out = F.replace(out, F.lit(ESCAPE + code), F.lit(c))
    return out


def normal(kind: Column, value: Column) -> Column:
    """The form in which spellings of an entity agree."""
    digits = F.regexp_replace(value, "[^0-9A-Za-z+]", "")
    return F.lower(F.when(kind.isin("E", "A", "V", "M", "F", "N"), value).when(kind == "K", value).otherwise(digits))


def luhn(digits: Column) -> Column:
    """A payment card's check digit after these digits."""
    def step(acc: Column, c: Column) -> Column:
        twice = c.cast("int") * 2
        return F.struct((-acc["left"] + 1).alias("left"), (acc["sum"] + F.when(acc["left"] == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))).alias("sum"))

    total = F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(1).alias("left"), F.lit(0).alias("sum")), step)["sum"]
    return ((10 - total % 10) % 10).cast("string")


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN, of lower-case country and rest."""
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 87) % 97)

    return F.lpad((98 - F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)).cast("string"), 2, "0")


_CYRILLIC = [chr(0x430 + i) for i in range(32)]
# Syllables and endings of made-up names.
_SYLLABLES = {
    "Latin": "ba be bi bo da de di do fa fe ga go ka ke ko la le li lo ma me mi mo na ne no pa ra ri sa ta va".split(),
    "Cyrillic": "ба бе би бо да де ди до фа фе га го ка ке ко ла ле ли ло ма ме ми мо на не но па ра ри са та ва".split(),
}
_ENDINGS = {
    ("Latin", "M"): "rik mar ton vin len dor bert nald".split(), ("Latin", "F"): "lina nella rissa vita dora mina sella tana".split(), ("Latin", "N"): "mann ford well sson ton ley berg court".split(),
    ("Cyrillic", "M"): "рик мар тон вин лен дор слав мир".split(), ("Cyrillic", "F"): "лина нелла риса вита дора мина села тана".split(), ("Cyrillic", "N"): "ченко евич ский ук ян ейко арь ич".split(),
}


def draw(kind: Column, norm: Column, n: int, key: str) -> Column:
    """The n-th surrogate of a normal form, in normal form."""
    def stream(*what: Column) -> Column:
        return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), *what, F.lit(str(k))), 256) for k in range(5)))

    def byte(h: Column, i: Column) -> Column:
        return F.conv(F.substr(h, i * 2 % 318 + 1, F.lit(2)), 16, 10).cast("int")

    h = stream(kind, norm, F.lit(str(n)))

    def spell(text: Column, h: Column, letters: int = 26) -> Column:
        def one(c: Column, i: Column) -> Column:
            digit = F.chr((byte(h, i) % 10 + 48).cast("long"))
            letter = F.chr((byte(h, i) % letters + 97).cast("long"))
            other = F.element_at(F.array(*map(F.lit, _CYRILLIC)), byte(h, i) % len(_CYRILLIC) + 1)
            return F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{IsCyrillic}"), other).when(c.rlike(r"\p{L}"), letter).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    domain = F.substring_index(norm, "@", -1)
    name = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.concat(spell(F.substring_index(norm, "@", 1), h), F.lit("@"), spell(name, stream(F.lit("domain"), domain)), F.lit("."), F.substring_index(domain, ".", -1))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(h, i) % 254 + 1).cast("string")), ".")
    phone = F.concat(F.regexp_extract(norm, r"^\+?\d", 0), spell(F.regexp_replace(norm, r"^\+?\d", ""), h))
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    account = spell(F.substr(norm, F.lit(5)), h)
    card = spell(F.substr(norm, F.lit(1), F.length(norm) - 1), h)

    def people(script: str) -> Column:
        syllables = F.array(*map(F.lit, _SYLLABLES[script]))
        stem = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2 + n // 3)), lambda i: F.element_at(syllables, byte(h, i) % 32 + 1)), "")
        end = lambda k: F.element_at(F.array(*map(F.lit, _ENDINGS[script, k])), byte(h, F.lit(0)) % 8 + 1)
        return F.concat(stem, F.when(kind == "M", end("M")).when(kind == "F", end("F")).otherwise(end("N")))

    return (
        F.when(kind == "E", email).when(kind == "A", octets).when(kind == "V", spell(norm, h, 6)).when(kind == "P", phone)
        .when(kind == "K", F.when(norm.rlike("^[0-9a-f]+$"), spell(norm, h, 6)).otherwise(spell(norm, h)))
        .when(kind == "B", F.concat(F.substring(norm, 1, 2), iban_check(F.substring(norm, 1, 2), account), account))
        .when(kind == "C", F.concat(card, luhn(card)))
        .when(kind.isin("M", "F", "N"), F.when(cyrillic, people("Cyrillic")).otherwise(people("Latin")))
        .otherwise(spell(norm, h))
    )


def lay_out(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate's characters in the spelling of one occurrence: its separators and case."""
    upper, first = value == F.upper(value), F.substring(value, 1, 1) == F.upper(F.substring(value, 1, 1))
    name = F.when(upper & (F.length(value) > 1), F.upper(surrogate)).when(first, F.initcap(surrogate)).otherwise(surrogate)

    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^0-9A-Za-z+]", ""))
        new = F.substr(surrogate, at, F.lit(1))
        return F.when(~c.rlike("[0-9A-Za-z]"), c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)

    rest = F.substr(surrogate, F.length(F.regexp_replace(value, "[^0-9A-Za-z+]", "")) + 1)  # of a longer surrogate
    spelled = F.concat(F.array_join(F.transform(F.split(value, ""), one), ""), rest)
    plain = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("M", "F", "N"), name).when(kind.isin("E", "A", "V"), plain).otherwise(F.when(kind == "K", F.when(F.length(value) == F.length(surrogate), F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(surrogate, i + 1, F.lit(1)))).otherwise(F.substr(surrogate, i + 1, F.lit(1)))), "")).otherwise(surrogate)).otherwise(spelled))


# The alphabets of a format's places: digits, hexadecimal letters, letters, octets, syllables.
_ALPHABETS = {"0": list("0123456789"), "a": list("abcdef"), "z": [chr(97 + i) for i in range(26)], "y": _CYRILLIC, "o": [str(i) for i in range(1, 255)], "s": _SYLLABLES["Latin"], "c": _SYLLABLES["Cyrillic"]}
_FAR = 1 << 50


def shape(kind: Column, norm: Column, longer: int, key: str) -> Column:
    """The format of a normal form's surrogates: a fixed head, places by alphabet (other characters stay), a fixed tail.

    ``longer`` places are added at the end.
    """
    def places(text: Column, letter: str) -> Column:
        latin = F.regexp_replace(text, r"[\p{L}&&[^\p{IsCyrillic}]]", letter)
        return F.regexp_replace(F.regexp_replace(latin, r"\p{IsCyrillic}", "y"), "[0-9]", "0")

    people, cyrillic = kind.isin("M", "F", "N"), norm.rlike(r"\p{IsCyrillic}")
    hexadecimal = (kind == "V") | (kind == "K") & norm.rlike("^[0-9a-f]+$")
    script = lambda latin, other: F.when(cyrillic, F.lit(other)).otherwise(F.lit(latin))
    head = F.when(kind == "P", F.regexp_extract(norm, r"^\+?\d", 0)).when(kind == "B", F.substring(norm, 1, 2)).otherwise("")
    own = F.when(kind == "E", F.substring_index(norm, "@", 1)).otherwise(F.substr(norm, F.length(head) + 1))
    more = F.when(people, script("s", "c")).when(kind == "A", ".o").when(hexadecimal, "a").when(kind.isin("E", "K"), "z").otherwise("0")
    pattern = F.when(people, script("sss", "ccc")).when(kind == "A", "o.o.o.o").when(hexadecimal, places(own, "a")).otherwise(places(own, "z"))
    ends = lambda k: script(_ENDINGS["Latin", k][0], _ENDINGS["Cyrillic", k][0])
    tail = F.when(kind == "M", ends("M")).when(kind == "F", ends("F")).when(kind == "N", ends("N"))
    tail = tail.when(kind == "E", F.concat(F.lit("@"), F.substring_index(draw(kind, norm, 0, key), "@", -1))).otherwise("")
    return F.struct(kind.alias("kind"), head.alias("head"), F.concat(pattern, F.repeat(more, F.lit(longer))).alias("pattern"), tail.alias("tail"))


def _size(place: Column) -> Column:
    out = F.lit(1)
    for c, alphabet in _ALPHABETS.items():
        out = F.when(place == c, len(alphabet)).otherwise(out)
    return out.cast("long")


def room(pattern: Column) -> Column:
    """How many values a format has, _FAR at most."""
    return F.aggregate(F.split(pattern, ""), F.lit(1).cast("long"), lambda n, c: F.least(n * _size(c), F.lit(_FAR)))


def value_at(form: Column, n: Column) -> Column:
    """The n-th value of a format, from 0."""
    def step(acc: Column, c: Column) -> Column:
        at = (acc["left"] % _size(c)).cast("int")
        one = c
        for place, alphabet in _ALPHABETS.items():
            one = F.when(c == place, F.element_at(F.array(*map(F.lit, alphabet)), F.when(c == place, at).otherwise(0) + 1)).otherwise(one)
        return F.struct(F.floor(acc["left"] / _size(c)).cast("long").alias("left"), F.concat(acc["out"], one).alias("out"))

    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    return F.concat(form["head"], F.aggregate(F.split(form["pattern"], ""), start, step)["out"], form["tail"])


def by_rank(waiting: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for all that wait: unused values of their formats; forbidden has (kind_, taken)."""
    from pyspark.sql import Window

    out, longer = None, 0
    while not waiting.isEmpty():
        formed = waiting.withColumn("form", shape(F.col("kind"), F.col("norm"), longer, key))
        rank = F.row_number().over(Window.partitionBy("form").orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm"), 256)))
        formed = settle(formed.withColumn("rank", rank))
        # Of the first (taken + waiting) values of a format as many as wait are free, if it has so many.
        of_kind = forbidden.groupBy("kind_").agg(F.count("*").alias("n_taken"))
        forms = formed.groupBy("form").agg(F.count("*").alias("n")).join(of_kind, F.col("form.kind") == F.col("kind_"))
        forms = forms.select("form", "n", F.least(room(F.col("form.pattern")), F.col("n") + F.col("n_taken")).alias("top"))
        block = 1 << 12
        values = forms.select("form", "n", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - 1) / block))).alias("block"))
        values = values.repartition("form", "block")
        last = F.least(F.col("top"), (F.col("block") + 1) * block) - 1
        values = values.select("form", "n", F.explode(F.sequence(F.col("block") * block, last)).alias("at"))
        values = values.select("form", "n", "at", value_at(F.col("form"), F.col("at")).alias("surrogate"))
        values = values.join(forbidden, (F.col("form.kind") == F.col("kind_")) & (F.col("surrogate") == F.col("taken")), "left_anti")
        # A value that two formats have goes to one of them.
        values = values.groupBy(F.col("form.kind").alias("kind_"), "surrogate").agg(F.min(F.struct("form", "n", "at")).alias("own"))
        place = F.row_number().over(Window.partitionBy("own.form").orderBy("own.at"))
        free = values.select("surrogate", F.col("own.form").alias("form_"), F.col("own.n").alias("n_"), place.alias("place")).where("place <= n_")
        given = formed.join(free, (F.col("form") == F.col("form_")) & (F.col("rank") == F.col("place")), "left")
        given = settle(given.select("kind", "norm", "surrogate"))
        new = given.where("surrogate is not null")
        out = new if out is None else out.unionAll(new)
        forbidden = forbidden.unionAll(new.select(F.col("kind").alias("kind_"), F.col("surrogate").alias("taken")))
        waiting, longer = given.where("surrogate is null").select("kind", "norm"), longer + 1
    return out


def assign(originals: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct (kind, norm), checked for collisions as the module says."""
    taken = waiting = originals = settle(originals.select("kind", "norm").distinct())
    accepted = None
    for n in range(MAX_DRAWS):
        drawn = waiting.withColumn("surrogate", draw(F.col("kind"), F.col("norm"), n, key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("winner"))
        forbidden = taken.select(F.col("kind").alias("kind_"), F.col("norm").alias("taken"))
        if accepted is not None:
            forbidden = forbidden.unionAll(accepted.select("kind", "surrogate"))
        free = first.join(forbidden, (F.col("kind") == F.col("kind_")) & (F.col("surrogate") == F.col("taken")), "left_anti")
        free = free.select(F.col("kind").alias("kind_"), F.col("winner"))
        good = drawn.join(free, (F.col("kind") == F.col("kind_")) & (F.col("norm") == F.col("winner")), "left")
        good = settle(good.select("kind", "norm", "surrogate", F.col("winner").isNotNull().alias("good")))
        new = good.where("good").select("kind", "norm", "surrogate")
        accepted = new if accepted is None else accepted.unionAll(new)
        waiting = good.where("not good").select("kind", "norm")
        if waiting.isEmpty():
            return accepted
    forbidden = taken.unionAll(accepted.select("kind", "surrogate")).toDF("kind_", "taken")
    return accepted.unionAll(by_rank(waiting, forbidden, key))


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents, all columns, with surrogates in the text. ``count_col`` adds the number of entities.

    ``key`` is the secret from which surrogates are drawn; with another key all are others. Null and empty texts stay;
    rows with null or repeated ids are replaced each by its own text; an empty table stays one.
    """
    text = F.col(text_col).cast("string")
    names = docs.columns
    # Marks are made once, for all rows: what has none is passed on, what has some is looked up by id and text.
    all_ = mark(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text.alias("text")))
    all_ = settle(all_.select("row", F.when(F.col("text").contains(OPEN), F.col("text")).alias("marked")))
    clean = all_.where("marked is null").select("row", F.col(f"row.`{text_col}`").cast("string").alias("new"), F.lit(0).cast("long").alias("n"))
    dirty = all_.where("marked is not null").select("row", "marked", F.md5(F.concat_ws("\x1f", F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")), "marked").cast("binary")).alias("name"))
    found = dirty.select("name", F.explode(entities(F.col("marked"))).alias("entity")).distinct()
    kind, value = F.substring("entity", 1, 1), F.substr("entity", F.lit(2))
    found = settle(found.select("name", "entity", kind.alias("kind"), normal(kind, value).alias("norm")))
    surrogates = assign(found, key).select(F.col("kind").alias("kind_"), F.col("norm").alias("norm_"), "surrogate")
    own = found.join(surrogates, (F.col("kind") == F.col("kind_")) & (F.col("norm") == F.col("norm_")))
    own = own.select("name", "entity", lay_out(F.col("kind"), F.substr("entity", F.lit(2)), F.col("surrogate")).alias("to"))
    own = own.groupBy(F.col("name").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("entity", "to"))).alias("to"))
    dirty = dirty.join(own, F.col("name") == F.col("of")).withColumn("parts", parts(F.col("marked")))
    joined = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, F.element_at(F.col("to"), x)).otherwise(x)), "")
    restored = F.when(joined.contains(ESCAPE), unescape(joined)).otherwise(joined)
    dirty = dirty.select("row", restored.alias("new"), ((F.size("parts") - 1) / 2).cast("long").alias("n"))
    out = [F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names]
    return dirty.unionAll(clean).select(*out, *([] if count_col is None else [F.col("n").alias(count_col)]))
