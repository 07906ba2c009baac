"""PII surrogates: detected entities get keyed, type-consistent replacements, in DataFrame operations only.

One pattern finds mail addresses, IP addresses, account and card numbers, social security and phone
numbers, and persons after a title. A mention's *canonical form* (digits of a phone number, a mail
address in lower case, a family name) names its entity, so that all spellings of an entity get one
surrogate, each in its own format. A surrogate is drawn from a hash of key, type, form and attempt:
digits become digits, letters letters of the same script and case, cards keep their Luhn check,
names come from lists of the title's gender and the name's script, or are composed of syllables of it, initials become other initials. Surrogates are then checked
against each other and against all originals of the type; an entity that collides draws again until
none does, so distinct entities stay distinct and no surrogate is someone else's original.

A person is found after a title, with initials, particles and any number of names. The names found
in a text are its own list: their untitled mentions in it, the family name alone or after known given
names, are replaced alike, and a title without gender (Dr, Prof) takes the person that the text knows.

Texts are cut at the matches and joined again with the mention's replacement; only texts with a
mention travel.

Defined results. NULL and empty texts, and texts without a mention, stay as they are. Repeated rows
are rewritten alike. Documents whose id repeats are told apart by their text. Other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch, table

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles by the gender that they tell (fixed values of the languages).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "госпожа", "Госпожа", "κυρία", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "господин", "Господин", "κύριος", "Κύριος"],
    "n": ["Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "доктор", "Доктор", "профессор", "Профессор", "Δρ"],
}
#: Given and family names by gender and script (fixed values).
GIVEN = {
    ("f", "latin"): "Ada Alice Anna Bella Carla Clara Dora Edith Elena Emma Eva Flora Greta Helen Ida Irene Julia Karin Laura Lena Lucia Maria Nina Nora Olga Paula Rita Rosa Sara Vera".split(),
    ("m", "latin"): "Adam Albert Anton Bruno Carl Daniel David Emil Erik Felix Frank Georg Henry Hugo Jakob Jonas Karl Leo Lucas Martin Max Oscar Otto Paul Peter Robert Simon Thomas Victor Walter".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лариса Мария Надежда Ольга Полина Софья Татьяна".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Сергей Тимур".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Ζωή Θάλεια Κατερίνα Μαρία Νίκη Σοφία Χλόη".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Κώστας Λουκάς Μάριος Νίκος Πέτρος Στέφανος Φώτης".split(),
}
FAMILY = {
    ("f", "latin"): "Arden Baker Castell Dorner Ellis Farrow Garner Holm Irving Jansen Keller Lindner Marlow Norden Osborn Palmer Quist Rowan Sander Talbot".split(),
    ("f", "cyrillic"): "Белова Волкова Громова Дёмина Ершова Жукова Зайцева Крылова Лебедева Морозова".split(),
    ("m", "cyrillic"): "Белов Волков Громов Дёмин Ершов Жуков Зайцев Крылов Лебедев Морозов".split(),
    ("f", "greek"): "Αγγέλου Βλάχου Γεωργίου Δήμου Ζέρβα Κοσμά Λάμπρου Μάνου Παππά Ρήγα".split(),
    ("m", "greek"): "Αγγέλου Βλάχος Γεωργίου Δήμου Ζέρβας Κοσμάς Λάμπρου Μάνος Παππάς Ρήγας".split(),
}
FAMILY["m", "latin"] = FAMILY["f", "latin"]
#: Consonants and vowels of composed names, and their endings: given f, given m, family f, family m.
SYLLABLES = {
    "latin": ("bcdfghklmnprstvw", "aeiou", ["a", "ia", "ina", "ella"], ["o", "us", "an", "er"], ["son", "man", "ing", "ford"], ["son", "man", "ing", "ford"]),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ["а", "ия", "ина", "ела"], ["ан", "ир", "ей", "ор"], ["ова", "ина", "ева", "енко"], ["ов", "ин", "ев", "енко"]),
    "greek": ("βγδκλμνπρστφ", "αεηιο", ["α", "η", "ια", "ινα"], ["ος", "ης", "ας", "ων"], ["ου", "ακη", "ιδου", "α"], ["ος", "ακης", "ιδης", "ας"]),
}
for _s in ("latin", "cyrillic", "greek"):
    GIVEN["n", _s], FAMILY["n", _s] = GIVEN["f", _s] + GIVEN["m", _s], FAMILY["m", _s]
#: Letters of each script in either case; a letter of no listed script becomes a Latin one.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "0123456789"]

#: White space with one line end at most.
_WS = r"(?:[\p{Z}\t\r\f]++\n?+|\n)[\p{Z}\t\r\f]*+"
_GENDERED, _NEUTRAL, _TITLE = "|".join(TITLES["f"] + TITLES["m"]), "|".join(TITLES["n"]), "|".join(TITLES["f"] + TITLES["m"] + TITLES["n"])
_AFTER = rf"(?:\.(?:{_WS})?+|{_WS})"
_NEUTRAL_HEAD = rf"(?:(?:{_NEUTRAL}){_AFTER})++"
_HEAD = rf"(?:(?:{_GENDERED}){_AFTER}(?:(?:{_NEUTRAL}){_AFTER})*+|{_NEUTRAL_HEAD})"
#: A name of two letters or more, without a possessive s, and an initial. No title is a name.
_MORE = r"['’-](?!s(?!\p{L}))[\p{L}\p{M}]++"
_NAME = rf"(?<![\p{{L}}\p{{M}}])(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}(?:[\p{{L}}\p{{M}}]++(?:{_MORE})*+|(?:{_MORE})++)"
_LETTER = r"(?<![\p{L}\p{M}])\p{Lu}(?![\p{L}\p{M}'’-])"
_INITIAL = rf"(?:-?{_LETTER}(?:\.(?:{_WS})?+|{_WS}))"
#: Particles right after a title; only the first ones can also stand after a name, where others are articles.
_LEADS = r"van|von|vom|zu|de|del|della|da|di|du|dos|bin|ibn|af|av|ten|ter"
_PARTICLE = rf"(?:(?:{_LEADS}|zum|zur|den|der|des|degli|dei|das|do|la|las|los|le|el|al|ben|te){_WS}|[dl]['’])"
_INNER = rf"(?:(?=(?:{_LEADS}){_WS}|[dl]['’])(?:{_PARTICLE})++)?+"
_PERSON = rf"(?:{_PARTICLE})*+(?:{_INITIAL})*+{_INNER}{_NAME}(?:{_WS}(?:{_INITIAL})*+{_INNER}{_NAME})*+"
_TOKEN = rf"{_NAME}|{_LETTER}"
#: Kind and pattern, tried in this order at each place; a host name has 127 labels at most. A *bare* run of digits is a
#: mention only if it is a number that the corpus has as a phone number. Look-behinds keep each scan of a run of letters or digits to one.
KINDS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,125}\.\p{L}{2,}"),
    ("ip", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+])\+[0-9](?:[ .-]?[0-9]){7,13}(?![0-9])"),
    ("bare", r"(?<![\p{L}\p{N}+.,-])[0-9]{7,13}(?![\p{L}\p{N}]|[.,-][0-9])"),
    ("person", rf"(?<!\p{{L}}){_HEAD}{_PERSON}"),
]
#: Country codes of one digit and of two; all others have three (fixed values of the numbering plan).
_COUNTRY = r"1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
#: What a mention of each kind can begin with, looked at before anything else of its pattern.
_HEADS = {"email": r"[\p{L}\p{N}._%+-]", "iban": "[A-Z]", "person": f"[{''.join(sorted({t[0] for g in TITLES.values() for t in g}))}]"}
PATTERN = "|".join(f"(?={_HEADS.get(k, '[0-9(+]')}){p}" for k, p in KINDS)
#: A title.
_TITLED = rf"(?={_HEADS['person']})(?<!\p{{L}}){_HEAD}"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _draw(seed: Column, place: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(n)).cast("int")


def _like(text: Column, seed: Column) -> Column:
    """Each letter and digit replaced by one of its script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"\p{L}"), F.substring(F.lit(ALPHABETS[0]), _draw(seed, i, 26) + 1, F.lit(1))).otherwise(c)
        for letters in ALPHABETS:
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(number: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""

    def share(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), share), F.lit(0), lambda a, x: a + x)


def _listed(lists: dict, gender: Column, script: Column, seed: Column) -> Column:
    out = F.lit(None).cast("string")
    for (g, s), names in lists.items():
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), _draw(seed, F.lit(0), len(names)) + 1)
        out = F.when((gender == g) & (script == s), pick).otherwise(out)
    return out


def _composed(part: int, gender: Column, script: Column, seed: Column, syllables: Column) -> Column:
    """A name of so many syllables and an ending of the gender, in the script; ``part`` is 0 for given names, 2 for family names."""
    def pick(letters, place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in letters]), _draw(seed, place, len(letters)) + 1)

    out = F.lit(None).cast("string")
    for name, (consonants, vowels, *endings) in SYLLABLES.items():
        body = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: F.concat(pick(consonants, 2 * i), pick(vowels, 2 * i + 1))), "")
        end = F.when(gender == "f", pick(endings[part], F.lit(1))).otherwise(pick(endings[part + 1], F.lit(1)))
        out = F.when(script == name, F.initcap(F.concat(body, end))).otherwise(out)
    return out


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The replacement that an entity draws at an attempt. Kinds of names end in their gender."""
    seed = F.sha2(F.concat_ws("\u001f", F.lit(key), kind, form, attempt.cast("string")), 256)
    like = _like(form, seed)
    gender, script = F.substring(kind, -1, 1), _script(form)
    grown = F.when(attempt > 2, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.substring(F.lit(ALPHABETS[0]), _draw(seed, -i, 26) + 1, F.lit(1))), "")).otherwise("")
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    body = F.concat(F.substring(form, 1, 1), F.substring(like, 2, F.length(form) - 2))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    last = F.when(_luhn(form) % 10 == 0, check).otherwise(F.substring(like, -1, 1))
    at = F.instr(form, "@")
    top = F.substring_index(form, ".", -1)
    return F.when(kind == "email", F.concat(F.substring(like, F.lit(1), at - 1), grown, F.substring(like, at, F.length(form) - F.length(top) - at + 1), top)) \
        .when(kind == "ip", octets) \
        .when(kind == "card", F.concat(body, last)) \
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(like, 2, 8))) \
        .when(kind == "iban", F.concat(F.substring(form, 1, 2), F.substring(like, F.lit(3), F.length(form)))) \
        .when(kind.startswith("given"), F.when(attempt < 1, _listed(GIVEN, gender, script, seed)).otherwise(_composed(0, gender, script, seed, attempt + 1))) \
        .when(kind.startswith("family"), F.when(attempt < 1, _listed(FAMILY, gender, script, seed)).otherwise(_composed(2, gender, script, seed, attempt + 1))) \
        .otherwise(like)


def maybe(text: Column) -> Column:
    """A cheap test that every text with a mention passes: each kind needs an at sign, a digit or a title."""
    return F.coalesce(text.contains("@") | text.rlike("[0-9]") | text.rlike(_TITLED), F.lit(False))


def kinds_of(found: DataFrame) -> DataFrame:
    """``found`` (mention) with the kind of each mention, in ``kind``."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.col("mention").rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    return found.withColumn("kind", kind)


def _tail(mention: Column) -> Column:
    """A person's mention without its titles."""
    return F.regexp_replace(mention, f"^{_HEAD}", "")


def _tokens(tail: Column) -> Column:
    """Names and initials in order; the last one is the family name."""
    return F.regexp_extract_all(tail, F.lit(_TOKEN), F.lit(0))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, though lambdas in it read it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parts(found: DataFrame) -> DataFrame:
    """The entities of each mention: (mention, part, kind, form, word); a person has a family name and perhaps given ones."""
    m = F.col("mention")
    title = F.regexp_extract(m, rf"^(?:{_TITLE})(?!\p{{L}})", 0)
    gender = F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("n")
    # The national number: behind the country code where there is one, without the zero that only calls inside a country begin with.
    phone = F.regexp_replace(F.when(m.startswith("+"), F.regexp_replace(digits(m), rf"^(?:{_COUNTRY})", "")).otherwise(digits(m)), "^0", "")
    form = F.when(F.col("kind") == "email", F.lower(m)).when(F.col("kind") == "ip", m) \
        .when(F.col("kind") == "iban", F.regexp_replace(m, " ", "")) \
        .when(F.col("kind").isin("phone", "bare"), phone).otherwise(digits(m))

    def entity(part: str, kind: Column, of: Column, word: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), kind.alias("kind"), of.alias("form"), word.alias("word"))

    def named(part: str) -> Callable[[Column], Column]:
        return lambda t: entity(part, F.concat(F.lit(f"{part} "), F.col("gender")), F.initcap(t), t)

    found = found.withColumn("gender", gender).withColumn("names", F.when(F.col("kind") == "person", _tokens(_tail(m))))
    given = F.array_distinct(F.filter(F.slice("names", F.lit(1), F.size("names") - 1), lambda t: F.length(t) > 1))
    person = F.concat(F.transform(given, named("given")), F.transform(F.slice("names", -1, 1), named("family")))
    one = F.array(entity("only", F.col("kind"), form, F.lit(None).cast("string")))
    return found.select("mention", F.explode(F.when(F.col("kind") == "person", person).otherwise(one)).alias("e")).select("mention", "e.*")


def entities_of(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """The parts of mentions with the kind of their entity.

    A family name is one entity whatever the title; a given name under a title without gender is the
    one that the corpus knows under a title with one. A bare number that is no phone number is dropped.
    """
    pieces = scratch.keep(pieces, "parts")
    phones = pieces.where("kind = 'phone'").select("form").distinct()
    bare = pieces.where("kind = 'bare'").join(phones, "form", "left_semi").withColumn("kind", F.lit("phone")).select(*pieces.columns)
    whole = pieces.where("part = 'only' AND kind <> 'bare'").unionByName(bare)
    named = pieces.where("part <> 'only'")
    gender = F.substring("kind", -1, 1)
    known = named.groupBy("part", "form").agg(F.min(gender).alias("known"))
    kind = F.concat_ws(" ", "part", F.when((F.col("part") == "family") | (gender == "n"), F.col("known")).otherwise(gender))
    return named.join(known, ["part", "form"]).withColumn("kind", kind).select(*pieces.columns).unionByName(whole)


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Collision-free (kind, form, sur) of distinct entities (kind, form).

    Names of both genders share one space of surrogates. A settled entity never moves again, so each
    round only the colliding ones draw, out of a space that grows with the attempt.
    """
    space = F.split("kind", " ")[0]
    drawn = entities.withColumn("attempt", F.lit(0))
    drawn = scratch.keep(drawn.withColumn("space", space).withColumn("sur", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)), "draw0")
    taken = scratch.keep(drawn.select(F.col("space").alias("s"), F.lower("form").alias("f")).distinct(), "originals")
    k = 0
    while True:
        # The first to draw a surrogate keeps it unless it is an original: one winner a surrogate, looked up by entity, so a surrogate that many draw meets nowhere.
        first = F.min(F.struct("attempt", "kind", "form")).alias("first")
        winners = drawn.groupBy(F.col("space").alias("s"), F.lower("sur").alias("f")).agg(first).join(taken, ["s", "f"], "left_anti")
        settled = winners.select(F.col("first.kind").alias("kind"), F.col("first.form").alias("form"), F.lit(True).alias("settled"))
        seen = drawn.join(settled, ["kind", "form"], "left")
        bad = F.col("settled").isNull()
        again = F.col("attempt") + F.when(bad, 1).otherwise(0)
        seen = seen.select("kind", "form", again.alias("attempt"), "space", F.when(bad, surrogate(F.col("kind"), F.col("form"), again, key)).otherwise(F.col("sur")).alias("sur"), bad.alias("moved"))
        k += 1
        drawn = scratch.keep(seen, f"draw{k}")
        if drawn.where("moved").isEmpty():
            return drawn.select("kind", "form", "sur")
        drawn = drawn.drop("moved")


def _in_format(mention: Column, sur: Column, kept: str) -> Column:
    """``sur`` written over the characters of class ``kept`` in ``mention``, right-aligned; earlier ones and separators stay."""
    total = F.length(F.regexp_replace(mention, f"[^{kept}]", ""))

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), f"[^{kept}]", ""))
        place = before - (total - F.length(sur))
        return F.when(c.rlike(f"[{kept}]") & (place >= 0), F.substring(sur, place + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(mention), one), "")


def _renamed(tail: Column, key: str, given: Callable[[Column], Column], family: Callable[[Column], Column]) -> Column:
    """A person's names written anew; particles and white space stay. ``given`` and ``family`` find the surrogate of a form."""
    def renamed(names: Column) -> Column:
        last = F.element_at(names, -1)

        def one(t: Column) -> Column:
            initial = _like(t, F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit("initial"), F.initcap(last), t), 256))
            return loud(t, F.when(F.length(t) == 1, initial).otherwise(given(F.initcap(t))))

        first = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), one)
        return F.concat(first, F.array(loud(last, family(F.initcap(last)))))

    def loud(t: Column, new: Column) -> Column:
        return F.when((F.length(t) > 1) & (t == F.upper(t)), F.upper(F.coalesce(new, t))).otherwise(F.coalesce(new, t))

    return F.array_join(F.zip_with(F.split(tail, _TOKEN, -1), _bound(_tokens(tail), renamed), lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))), "")


def replacements(found: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(mention, replacement) of the distinct mentions of a corpus, and (mention, part, gender, form, word, sur) of its persons."""
    pieces = scratch.keep(entities_of(parts(kinds_of(found)), scratch), "entities")
    drawn = assign(pieces.select("kind", "form").distinct(), key, scratch)
    known = pieces.join(drawn, ["kind", "form"])
    entry = F.when(F.col("part") != "only", F.struct(F.concat_ws(":", "part", "form").alias("key"), F.col("sur").alias("value")))
    named = known.groupBy("mention").agg(
        F.max(F.when(F.col("part") == "only", F.col("kind"))).alias("kind"), F.max(F.when(F.col("part") == "only", F.col("sur"))).alias("sur"),
        F.map_from_entries(F.collect_set(entry)).alias("names"))
    m, sur = F.col("mention"), F.col("sur")
    loud = (m == F.upper(m)) & (m != F.lower(m))
    tail = _tail(m)
    person = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(tail)),
                      _renamed(tail, key, *[lambda form, p=p: F.element_at("names", F.concat(F.lit(p), form)) for p in ("given:", "family:")]))
    out = F.when(F.col("kind").isNull(), person).when(F.col("kind") == "email", F.when(loud, F.upper(sur)).otherwise(sur)).when(F.col("kind") == "ip", sur) \
        .when(F.col("kind") == "iban", _in_format(m, sur, "A-Z0-9")).otherwise(_in_format(m, sur, "0-9"))
    people = known.where("part != 'only'").select("mention", "part", F.substring("kind", -1, 1).alias("gender"), "form", "word", "sur")
    return scratch.keep(named.select("mention", out.alias("replacement")), "replacements"), scratch.keep(people, "people")


def _any_of(words: Column) -> Column:
    """A pattern of any of ``words`` as written, with a capital or in capitals, longest first."""
    spelt = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.initcap(w), F.upper(w)))))
    ordered = F.transform(F.array_sort(F.transform(spelt, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda e: e["w"])
    return F.concat(F.lit("(?:"), F.array_join(F.concat(F.array(F.lit("(?!)")), ordered), "|"), F.lit(")"))


def names_of_texts(own: DataFrame, people: DataFrame) -> DataFrame:
    """(t1, t2, __pattern, __names): the names of each text that has a person, and the pattern of its mentions, titled or not.

    ``__names`` has (gender, surrogate) by part and form, and by part, gender and form; a title that
    tells the gender goes before one that does not.
    """
    rows = own.join(people, "mention").select("t1", "t2", "part", "gender", "form", "word", "sur")
    keys = F.array(F.concat_ws(":", "part", "form"), F.concat_ws(":", "part", "gender", "form"))
    best = rows.withColumn("key", F.explode(keys)).groupBy("t1", "t2", "key").agg(F.min(F.struct("gender", "sur")).alias("value"))
    found = best.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__names"))
    words = rows.groupBy("t1", "t2").agg(*[F.sort_array(F.collect_set(F.when(F.col("part") == p, F.col("word")))).alias(p) for p in ("given", "family")])
    end = r"(?![\p{L}\p{M}\p{N}])"
    pattern = F.concat(F.lit(PATTERN + r"|(?=\p{Lu})(?<![\p{L}\p{M}\p{N}])(?:"), _any_of(F.col("given")), F.lit(rf"{end}{_WS}(?:{_INITIAL})*+{_INNER}){{0,9}}"),
                       _any_of(F.col("family")), F.lit(end + r"(?![\p{L}\p{N}._%+-]*+@)"))
    return found.join(words.select("t1", "t2", pattern.alias("__pattern")), ["t1", "t2"])


def _known(mention: Column, key: str) -> Column:
    """An untitled mention, or one whose title tells no gender, by the names of its text."""
    tail = _tail(mention)
    first = F.initcap(F.element_at(F.filter(_tokens(tail), lambda t: F.length(t) > 1), 1))
    gender = F.element_at("__names", F.concat(F.lit("given:"), first))["gender"]

    def family(form: Column) -> Column:
        return F.coalesce(F.element_at("__names", F.concat(F.lit("family:"), gender, F.lit(":"), form))["sur"], F.element_at("__names", F.concat(F.lit("family:"), form))["sur"])

    def given(form: Column) -> Column:
        return F.element_at("__names", F.concat(F.lit("given:"), form))["sur"]

    return F.concat(F.substring(mention, F.lit(1), F.length(mention) - F.length(tail)), _renamed(tail, key, given, family))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every detected entity replaced; ``count_col`` adds the number of mentions replaced."""
    inner = [f"in{i}" for i in range(len(docs.columns))]  # no name of a caller's column meets one of ours
    out = _pseudonymised(docs.toDF(*inner), key, inner[docs.columns.index(text_col)], count_col and "count")
    return out.toDF(*docs.columns, *([count_col] if count_col else []))


def _pseudonymised(docs: DataFrame, key: str, text_col: str, count_col: str | None) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "surrogates")
    text = F.col(text_col)
    key1, key2 = F.xxhash64(text), F.hash(F.lit(31), text)
    likely = docs.where(maybe(text))
    own = scratch.keep(likely.select(key1.alias("t1"), key2.alias("t2"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))).alias("mention")).distinct(), "own")
    known, people = replacements(own.select("mention").distinct(), key, scratch)
    by_text = own.join(known, "mention").groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("__map"))
    by_text = by_text.join(names_of_texts(own, people), ["t1", "t2"], "left").withColumnsRenamed({"t1": "__map1", "t2": "__map2"})
    joined = likely.withColumn("__t1", key1).withColumn("__t2", key2).join(by_text, (F.col("__t1") == F.col("__map1")) & (F.col("__t2") == F.col("__map2")), "left")

    def rewritten_by(pattern: Column, replacement: Callable[[Column], Column]) -> tuple[Column, Column]:
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        pieces = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(replacement(m))))
        bare = F.size(F.filter(matches, lambda m: mapped(m).isNull() & m.rlike("^[0-9]+$")))
        return F.array_join(pieces, ""), F.size(matches) - bare

    def mapped(m: Column) -> Column:
        return F.element_at("__map", m)

    def kept(m: Column) -> Column:
        return F.coalesce(mapped(m), m)

    def person(m: Column) -> Column:
        bare = mapped(m).isNull() & m.rlike("^[0-9]+$")
        return F.when(bare, m).when(mapped(m).isNull() | m.rlike(rf"^{_NEUTRAL_HEAD}{_PERSON}$"), _known(m, key)).otherwise(mapped(m))

    plain, named = rewritten_by(F.lit(PATTERN), kept), rewritten_by(F.col("__pattern"), person)
    new = F.when(F.col("__map").isNull(), text).when(F.col("__pattern").isNull(), plain[0]).otherwise(named[0])
    number = F.when(F.col("__map").isNull(), F.lit(0)).when(F.col("__pattern").isNull(), plain[1]).otherwise(named[1])
    rewritten = joined.select(*[new.alias(text_col) if c == text_col else F.col(c) for c in docs.columns], *([number.alias(count_col)] if count_col else []))
    rest = docs.where(~maybe(text)).select(*[F.col(c) for c in docs.columns], *([F.lit(0).alias(count_col)] if count_col else []))
    return rest.unionByName(rewritten)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="documents-2024", count_col="n_replaced")
