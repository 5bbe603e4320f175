"""Personal data replaced by keyed surrogates of the same kind and format.

DataFrame functions only.  One pattern finds e-mail addresses, IPv4 addresses,
phone, card and social security numbers, credentials, and names after a title.
A text with such a name is read again for further mentions of the same people
without a title, by full or family name.  Each match is replaced by its
canonical form and the key alone, so every mention of an entity gets the same
surrogate in any document and format.  A family name alone belongs to the one
full name of its text that ends in it; if there is none, or more than one, it
is an entity of its own.

Numbers go through keyed Feistel permutations: two different numbers can never
get one surrogate.  Phone numbers stay within their class of area and exchange
codes (a dialable number stays dialable), IPv4 addresses within their first
octet, or first two where private ranges begin in the second (a private address
stays private).  E-mail addresses, credentials and names draw from hashed
spaces; a check over all distinct entities redraws under the next attempt if
two ever met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Titles by gender, given names by gender and script.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Господин Κύριος"
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία"
NEUTRAL_TITLES = "Dr Prof"
GIVEN = {
    ("m", "latin"): "Alan Bruno Carl Dario Emil Felix Georg Hugo Ivan Jonas Karim Leon Marco Nils Otto Pablo",
    ("f", "latin"): "Alma Bella Clara Dora Elena Fiona Greta Helen Irma Julia Karla Lena Maria Nora Olga Paula",
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Марк Никита Олег Павел Роман Степан Тимур",
    ("f", "cyrillic"): "Алла Белла Вера Галина Дарья Ева Инна Клара Лариса Мария Нина Ольга Полина Рита Софья Таня",
    ("m", "greek"): "Άγις Βίκτωρ Γιάννης Δήμος Ηλίας Θάνος Ιάσων Κίμων Λέων Μάρκος Νίκος Ορέστης Πάρης Σάββας Τάσος Φώτης",
    ("f", "greek"): "Άννα Βάσω Γωγώ Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λίνα Μαρία Νίκη Ολγα Ρέα Φανή",
}
#: Sixteen syllables, one for each hex digit, in three scripts.
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ru sa te vi zo du ka",
    "cyrillic": "ба де фи го ку ла ме ни по ру са те ви зо ду ка",
    "greek": "βα δε φι γο κου λα με νι πο ρου σα τε βι ζο δου κα",
}

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[0-9]{12}|[0-9]{11}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![0-9A-Za-z])"
CLOUD_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
CREDENTIAL = r"(?<![A-Za-z])(?i:password|passwd|token|secret|api[_-]?key) {0,2}[=:] {0,2}[\"']?[A-Za-z0-9_+/-]{8,}"
_TITLES = "|".join((MALE_TITLES + " " + FEMALE_TITLES + " " + NEUTRAL_TITLES).split())
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"
TITLE = rf"^(?:{_TITLES})\.? "
#: Addresses before cards before phones, as the first alternative that matches at a place wins.  Directly after a
#: Latin letter only IP and SSN can match: that test comes first and spares the others inside words.
ANY = "(?:(?<![A-Za-z])(?:" + "|".join((EMAIL, IP, CARD, PHONE, SSN, CLOUD_KEY, CREDENTIAL, NAME)) + f")|(?<=[A-Za-z])(?:{IP}|{SSN}))"
KINDS = ("email", "ip", "card", "phone", "ssn", "cloud_key", "credential", "name")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email")
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "ip")
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(whole(r"[0-9 -]{15,19}"), "card")
        .when(whole(r"[0-9+() .-]+"), "phone")
        .when(whole(r"AKIA[0-9A-Z]{16}"), "cloud_key")
        .when(whole(CREDENTIAL), "credential")
        .otherwise("name")
    )


def canonical(m: Column, kind: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.transform(F.split(m, r"\."), lambda o: F.regexp_replace(o, "^0+(?=[0-9])", ""))
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "phone", F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "credential", F.regexp_extract(m, r"([A-Za-z0-9_+/-]{8,})$", 1))
        .when(kind == "name", F.regexp_replace(m, TITLE, ""))
        .otherwise(m)
    )


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(hexes: Column, at: int = 1) -> Column:
    return F.conv(F.substring(hexes, at, 12), 16, 10).cast("long")


def permuted(digits: Column, key: str) -> Column:
    """A keyed permutation of the digit strings of each length up to 18: four additive Feistel rounds."""

    def even(r: int, n: Column, left: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(((s["a"] + _number(_hash(key, F.lit(f"d{r}"), n, s["b"].cast("string")))) % 10**left).alias("a"), s["b"].alias("b"))

    def odd(r: int, n: Column, right: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["a"].alias("a"), ((s["b"] + _number(_hash(key, F.lit(f"d{r}"), n, s["a"].cast("string")))) % 10**right).alias("b"))

    def feistel(n: Column, left: int, right: int) -> Column:
        state = F.struct(F.substring(digits, 1, left).try_cast("long").alias("a"), F.substring(digits, left + 1, right).try_cast("long").alias("b"))
        for r in range(4):
            state = _let(state, even(r, n, left) if r % 2 == 0 else odd(r, n, right))
        return _let(state, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0")))

    out = F.when(F.lit(False), F.lit(""))
    for n in (9, 13, 14):
        out = out.when(F.length(digits) == n, feistel(F.lit(str(n)), n // 2, n - n // 2))
    return out


def permuted_phone(digits: Column, key: str) -> Column:
    """The last ten digits permuted: area and exchange codes that begin with 2 to 9 stay so, and the others stay others."""
    n = F.length(digits)
    area, rest = F.substring(digits, n - 9, F.lit(3)).try_cast("long"), F.substring(digits, n - 6, F.lit(7)).try_cast("long")

    def split(value: Column, unit: int) -> tuple[Column, Column, Column]:
        dialable = value >= 2 * unit
        return F.when(dialable, value - 2 * unit).otherwise(value), F.when(dialable, 2 * unit).otherwise(0), F.when(dialable, 8 * unit).otherwise(2 * unit)

    (a, a_from, a_size), (b, b_from, b_size) = split(area, 100), split(rest, 1_000_000)
    state = F.struct(*(c.cast("long").alias(k) for k, c in (("a", a), ("b", b), ("a_from", a_from), ("a_size", a_size), ("b_from", b_from), ("b_size", b_size))))

    def turn(r: int) -> Callable[[Column], Column]:
        mine, other = ("a", "b") if r % 2 == 0 else ("b", "a")

        def step(s: Column) -> Column:
            # The class goes into the draw, and is known from the result.
            drawn = _number(_hash(key, F.lit(f"p{r}"), s["a_size"].cast("string"), s["b_size"].cast("string"), s[other].cast("string")))
            new = {mine: (s[mine] + drawn) % s[f"{mine}_size"]}
            return F.struct(*(new.get(k, s[k]).alias(k) for k in ("a", "b", "a_from", "a_size", "b_from", "b_size")))

        return step

    for r in range(4):
        state = _let(state, turn(r))
    return _let(state, lambda s: F.concat(F.lpad((s["a"] + s["a_from"]).cast("string"), 3, "0"), F.lpad((s["b"] + s["b_from"]).cast("string"), 7, "0")))


#: First octets whose second octet tells private, shared or local ranges: both stay.
TWO_OCTETS = (100, 169, 172, 192)


def permuted_ip(ip: Column, key: str) -> Column:
    """The octets after the first (after the second for ``TWO_OCTETS``) permuted among all values under the same beginning."""

    def turn(r: int, size: int) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            drawn = _number(_hash(key, F.lit(f"i{r}"), s["net"], s["b"].cast("string")))
            return F.struct(s["net"].alias("net"), s["b"].alias("a"), ((s["a"] + drawn) % size).alias("b"))

        return step

    def feistel(net: Column, host: Column, size: int) -> Column:
        state = F.struct(net.alias("net"), F.floor(host / size).cast("long").alias("a"), (host % size).cast("long").alias("b"))
        for r in range(4):
            state = _let(state, turn(r, size))
        return _let(state, lambda s: _let(s["a"] * size + s["b"], lambda h: F.concat_ws(".", s["net"], *_octets(h, 3 if size == 4096 else 2))))

    def done(o: Column) -> Column:
        low = F.get(o, 2) * 256 + F.get(o, 3)
        first = F.get(o, 0).cast("string")
        two = feistel(F.concat_ws(".", first, F.get(o, 1).cast("string")), low, 256)
        return F.when(F.get(o, 0).isin(*TWO_OCTETS), two).otherwise(feistel(first, F.get(o, 1) * 65536 + low, 4096))

    return _let(F.transform(F.split(ip, r"\."), lambda o: o.try_cast("long")), done)


def _octets(value: Column, count: int) -> list[Column]:
    return [(F.floor(value / 256**i).cast("long") % 256).cast("string") for i in reversed(range(count))]


def luhn(digits: Column) -> Column:
    """The check digit that makes ``digits`` followed by it pass the Luhn test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when((n - i) % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return (10 - F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10) % 10


def permuted_card(digits: Column, key: str) -> Column:
    """First digit kept; the digits up to the check digit permuted; a check digit that was right stays right."""

    def done(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        off = (F.substring(d, F.length(d), F.lit(1)).try_cast("int") - luhn(body) + 10) % 10
        new = F.concat(F.substring(d, 1, 1), permuted(F.substring(d, F.lit(2), F.length(d) - 2), key))
        return _let(new, lambda x: F.concat(x, ((luhn(x) + off) % 10).cast("string")))

    return _let(digits, done)


def in_format(original: Column, digits: Column, skip: Column) -> Column:
    """``original`` with its digits after the first ``skip`` replaced by ``digits`` in order."""
    chars = F.filter(F.split(original, ""), lambda c: c != "")
    step = lambda s, c: F.when(
        c.rlike("[0-9]"),
        F.struct(
            F.concat(s["out"], F.when(s["at"] > skip, F.substring(digits, s["at"] - skip, F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + 1).alias("at"),
        ),
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, step)["out"]


def _spelled(hexes: Column, script: str, at: int, count: int) -> Column:
    """A capitalised word of ``count`` syllables, one for each hex digit."""
    table = F.split(F.lit(SYLLABLES[script]), " ")
    syllable = lambda i: F.element_at(table, F.conv(F.substring(hexes, i, F.lit(1)), 16, 10).cast("int") + 1)
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(at), F.lit(at + count - 1)), syllable), ""))


def gender_of(title: Column, given: Column) -> Column:
    """Of the title; under a neutral one, of the given name: listed as female, or else ending as most female ones do."""
    listed = lambda gender: "|".join(names.replace(" ", "|") for (g, _), names in GIVEN.items() if g == gender)
    by_name = F.when(given.rlike(rf"^(?:{listed('m')})$"), "m").when(given.rlike(rf"^(?:{listed('f')})$|[aаяαάη]$"), "f").otherwise("m")
    titled = lambda titles: title.rlike(rf"^(?:{titles.replace(' ', '|')})\.? $")
    return F.when(titled(MALE_TITLES), "m").when(titled(FEMALE_TITLES), "f").otherwise(by_name)


def surrogate_name(m: Column, hexes: Column, gender: Column) -> Column:
    """The title, if any, stays; a given name of ``gender`` where there was one, and a spelled family name in the script of the original."""
    title, rest = F.regexp_extract(m, TITLE, 0), F.regexp_replace(m, TITLE, "")
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit("")
    for (g, s), names in GIVEN.items():
        given = F.element_at(F.split(F.lit(names), " "), F.conv(F.substring(hexes, 1, 1), 16, 10).cast("int") + 1)
        # Twelve syllables: 48 bits.
        full = F.concat(F.when(rest.contains(" "), F.concat(given, F.lit(" "))).otherwise(F.lit("")), _spelled(hexes, s, 2, 12))
        out = F.when((gender == g) & (script == s), full).otherwise(out)
    return F.concat(title, out)


def surrogate(m: Column, kind: Column, canon: Column, gender: Column, key: str, attempt: int, numbers: bool = True) -> Column:
    """The surrogate of mention ``m``, in its format; without ``numbers`` right for kinds in hashed spaces only."""
    h = _hash(key, F.lit(str(attempt)), kind, canon)

    def hashed(hexes: Column) -> Column:
        email = F.concat(F.substring(hexes, 1, 20), F.lit("@m"), F.substring(hexes, 21, 6), F.lit(".example.org"))
        credential = F.concat(
            F.regexp_replace(m, r"[A-Za-z0-9_+/-]{8,}$", ""),
            F.substring(F.repeat(hexes, 1 + F.floor(F.length(canon) / 64).cast("int")), F.lit(1), F.greatest(F.length(canon), F.lit(20))),
        )
        return (
            F.when(kind == "email", email)
            .when(kind == "cloud_key", F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))))
            .when(kind == "credential", credential)
            .otherwise(surrogate_name(m, hexes, gender))
        )

    if not numbers:
        return _let(h, hashed)
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind == "ip", permuted_ip(canon, key))
        .when(kind == "card", in_format(m, permuted_card(canon, key), F.lit(0)))
        .when(kind == "ssn", in_format(m, permuted(canon, key), F.lit(0)))
        .when(kind == "phone", in_format(m, permuted_phone(canon, key), F.length(digits) - 10))
        .otherwise(_let(h, hashed))
    )


def people(text: Column) -> Column:
    """The distinct names after a title in ``text``, each with a gender, in order of appearance; null if the text is null."""
    named = F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1))

    def person(m: Column) -> Column:
        rest = F.regexp_replace(m, TITLE, "")
        return F.struct(rest.alias("name"), gender_of(F.regexp_extract(m, TITLE, 0), F.substring_index(rest, " ", 1)).alias("gender"))

    return F.array_distinct(F.transform(named, person))


def _family(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def pattern_for(persons: Column) -> Column:
    """``ANY``, and where there are ``persons`` their full and family names without a title (letters only, so they are their own patterns)."""
    full = F.filter(F.transform(persons, lambda p: p["name"]), lambda n: n.contains(" "))
    names = F.array_distinct(F.concat(full, F.transform(persons, lambda p: _family(p["name"]))))
    further = F.concat(F.lit(rf"|(?<!\p{{L}})(?=\p{{Lu}})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    return F.concat(F.lit(ANY), F.when(F.size(persons) > 0, further).otherwise(F.lit("")))


def _entities(text: Column, persons: Column, key: str, attempt: int, numbers: bool = True) -> Column:
    """Array of (mention, kind, canonical form, surrogate) in order of appearance."""
    found = F.regexp_extract_all(text, F.concat(F.lit("("), pattern_for(persons), F.lit(")")), F.lit(1))

    def resolved(m: Column, kind: Column) -> Column:
        """The canonical form; for a family name alone the one full name in the text that ends in it."""
        own = canonical(m, kind)
        full = F.array_distinct(F.transform(F.filter(persons, lambda p: p["name"].endswith(F.concat(F.lit(" "), own))), lambda p: p["name"]))
        return F.when((kind == "name") & ~own.contains(" ") & (F.size(full) == 1), F.get(full, 0)).otherwise(own)

    def gender(m: Column, canon: Column) -> Column:
        same = F.filter(persons, lambda p: _family(p["name"]) == _family(canon))
        exact = F.filter(same, lambda p: p["name"] == canon)
        titled = gender_of(F.regexp_extract(m, TITLE, 0), F.substring_index(canon, " ", 1))
        known = F.coalesce(F.get(exact, 0)["gender"], F.get(same, 0)["gender"], titled)
        return F.when(m.rlike(TITLE), titled).otherwise(known)

    def entity(m: Column) -> Column:
        return _let(
            _let(kind_of(m), lambda k: F.struct(m.alias("mention"), k.alias("kind"), resolved(m, k).alias("canonical"))),
            lambda e: F.struct(
                e["mention"].alias("mention"),
                e["kind"].alias("kind"),
                e["canonical"].alias("canonical"),
                surrogate(e["mention"], e["kind"], e["canonical"], gender(e["mention"], e["canonical"]), key, attempt, numbers).alias("surrogate"),
            ),
        )

    return F.transform(found, entity)


def collisions(docs: DataFrame, key: str, attempt: int, text_col: str = "text") -> DataFrame:
    """Surrogates in hashed spaces that two different entities share, over all documents."""
    hit = docs.select(F.col(text_col).alias("_t")).where(F.col("_t").rlike(ANY)).withColumn("_people", people(F.col("_t")))
    each = hit.select(F.explode(_entities(F.col("_t"), F.col("_people"), key, attempt, numbers=False)).alias("e")).where(F.col("e.kind").isin("email", "cloud_key", "credential", "name"))
    drawn = each.select(
        F.col("e.kind").alias("kind"),
        F.col("e.canonical").alias("canonical"),
        F.when(F.col("e.kind") == "credential", F.regexp_extract("e.surrogate", r"([A-Za-z0-9_+/-]{8,})$", 1)).otherwise(_family(F.col("e.surrogate"))).alias("drawn"),
    ).distinct()
    return drawn.groupBy("kind", "drawn").agg(F.count("*").alias("n")).where("n > 1")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", out: str = "text", found: str | None = None, attempts: int = 8) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, in column ``out``; ``found`` names an array column of what was found.

    * a null text stays null, with nothing found; a text without entities is unchanged
    * texts are read whole; overlapping matches: the leftmost, then the first kind of ``ANY``
    * names of one text that are also common words (a person called Young) are
      replaced in that text wherever they stand as a word of their own
    * repeated rows get equal results; other columns stay as they are, but
      ``out`` and ``found`` replace columns of these names
    * if ``attempts`` draws all collide, an error is raised rather than two
      entities merged; an empty table gives an empty result
    """
    attempt = 0
    while not cut(collisions(docs, key, attempt, text_col)).isEmpty():
        attempt += 1
        if attempt == attempts:
            raise RuntimeError("surrogates of different entities still collide")
    text = F.col(text_col)
    # Null where nothing is to be replaced, so that ANY is tried over a text without entities once.
    named = docs.withColumn("_zm_people", F.when(text.rlike(ANY), people(text)))
    persons = F.col("_zm_people")
    none = F.array().cast("array<struct<mention:string,kind:string,canonical:string,surrogate:string>>")
    listed = named.withColumn("_zm_found", F.coalesce(F.when(persons.isNotNull(), _entities(text, persons, key, attempt)), none))
    gaps = F.split(text, pattern_for(persons), -1)
    new = F.array_join(
        F.zip_with(gaps, F.col("_zm_found"), lambda g, e: F.concat(g, F.coalesce(e["surrogate"], F.lit("")))),
        "",
    )
    done = listed.withColumn(out, F.when(F.size("_zm_found") > 0, new).otherwise(text)).drop("_zm_people")
    return done.withColumnRenamed("_zm_found", found) if found else done.drop("_zm_found")
