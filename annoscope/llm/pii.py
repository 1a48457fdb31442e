"""Personal data and secrets: surrogates instead of blanks, with DataFrame functions only.

Entities are found by one pattern, in one pass over a text (``PATTERNS``: e-mail, password, key, hexadecimal secret, IBAN, phone,
social security number, card, IPv6, IPv4, titled name). Each becomes a surrogate of the same type drawn from a keyed SHA-2 of its
canonical form: equal entities get equal surrogates in the whole corpus (coreference, also across spellings such as case,
separators, or a phone number with and without its country code), and nobody without the key can tell which. A name's last word is
an entity of its own: a person's surname has the same surrogate with and without given names. Formats stay: separators, letter case,
digit counts, country codes, the check digits of a valid card or an IBAN, a name's number of words, its script (Latin, Cyrillic,
Greek, Armenian) and the gender of its title; a title without gender (Dr, Prof) makes a full name an entity of its own.

Distinctness is checked: over the corpus's distinct entities, a surrogate that two of them share, or that
is itself a found entity, is drawn again (next attempt) for all but the smallest. Surrogates are computed in the
row; only the entities with a later attempt are joined to their documents, from a written table.

Defined cases: a null text stays null, an empty one empty; rows that repeat an id are handled each for itself;
ids may be null; all other columns are kept as they are; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annoscope.session import written as saved

#: Titles by gender, and those without.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος", "Պարոն")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Госпожа", "Κυρία", "Տիկին")
OTHER_TITLES = ("Dr", "Prof", "Doctor", "Professor", "Доктор", "Профессор")
#: Surrogate given names by gender.
MALE_NAMES = ("Adam", "Albert", "Anton", "Benno", "Boris", "Bruno", "Carl", "Cesar", "Conrad", "Dario", "David", "Dominik", "Edgar", "Emil", "Erik", "Fabio",
              "Felix", "Franz", "Georg", "Gregor", "Gustav", "Harald", "Henrik", "Hugo", "Igor", "Ivan", "Jakob", "Janos", "Karim", "Kurt", "Leon", "Lukas",
              "Marko", "Milan", "Nikolai", "Nils", "Oskar", "Otto", "Pavel", "Peter", "Rafael", "Simon", "Tomas", "Urban", "Viktor", "Walter", "Yuri", "Zoltan")
FEMALE_NAMES = ("Adela", "Agnes", "Anna", "Beata", "Berta", "Carla", "Clara", "Dana", "Diana", "Dora", "Edith", "Elena", "Emma", "Eva", "Flora", "Frida",
                "Gerda", "Greta", "Hanna", "Helga", "Ida", "Irina", "Iris", "Jana", "Julia", "Karla", "Katja", "Lena", "Lucia", "Magda", "Maria", "Marta",
                "Mila", "Nadja", "Nora", "Olga", "Paula", "Petra", "Rita", "Rosa", "Sara", "Sofia", "Tamara", "Thea", "Ursula", "Vera", "Wanda", "Zoe")

_ANY_TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\.?"
#: One title or up to four in a row (Herr Prof. Dr.).
_TITLE = rf"{_ANY_TITLE}(?: {_ANY_TITLE}){{0,3}}"
#: Lower-case words inside names.
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "af", "al", "el", "bin", "ibn")
#: Latin, Greek, Cyrillic and Armenian letters and combining marks, as ranges: one class is matched without recursion.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u036f\u0370-\u052f\u0531-\u0587\u1e00-\u1fff"
_LETTER = f"[{_LETTERS}]"
#: Possessive endings ('s, 'll) are not of the name. Loops are possessive, so any number of words needs no stack.
_WORD = (rf"(?:(?:{'|'.join(PARTICLES)}) )*+(?:\p{{Lu}}\. ?(?=\p{{Lu}}))*+\p{{Lu}}{_LETTER}*+"
         rf"(?:['\u2019-](?!(?:s|ll|d|ve|re|m)\b){_LETTER}++)*+")
#: A password goes to the next white space or quote.
_UNSPACED = r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\"'`\u00ab\u00bb\u2018-\u201f]"
_ANNOUNCED = r"(?i:password|passphrase|passwd|pwd)[\"']? ?[=:] ?[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]"
_LOCAL = rf"[0-9{_LETTERS}._%+-]"
_LABEL = rf"[0-9{_LETTERS}-]++"
#: Patterns of entities that do not begin inside a run of ASCII letters and digits.
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++",
    "password": rf"{_ANNOUNCED}{_UNSPACED}++",
    "key": r"AKIA[0-9A-Z]{16}\b|gh[pousr]_[0-9A-Za-z]{20,}+|sk-(?=[A-Za-z_-]*+\d)[0-9A-Za-z_-]{20,}+",
    "secret": rf"{_HEX}{{32,}}+\b",
    "iban": r"[A-Z]{2}\d{2}(?=(?:[ A-Z]*+\d){6})(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])",
    "phone": r"\d{3}[ .-]\d{3}[ .-]\d{4}\b",
    "ssn": r"\d{3}-\d{2}-\d{4}\b",
    "card": r"\d{4}(?:[ -]\d{4}){3}\b|\d{4}[ -]\d{6}[ -]\d{5}\b|\d{13,19}\b",
    "ipv6": (rf"(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?=[A-Fa-f]{{0,3}}\d){_HEX}{{3,4}}(?::{_HEX}{{1,4}}){{0,6}}::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,6}})?)"
             r"(?![0-9A-Za-z:])"),
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}\b",
    "name": rf"{_TITLE} {_WORD}(?: {_WORD})*+",
}
#: Phones with a country code or an area code in brackets may begin anywhere.
_PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\+\d{1,3}[ .-]?\b\d{3}[ .-]\d{3}[ .-]\d{4}\b|\+\d(?:[ .()/-]{0,2}\d){8,14}(?!\d)"
PATTERN = rf"(?<![0-9A-Za-z])(?:{'|'.join(PATTERNS.values())})|(?=[+(])(?:{_PHONE})"
#: Country calling codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})(?:[ .-]?\(0\))?"

_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопярстувзыюэ", "αβξδεφγηιθκλμνοπψρστυωχζύά"
_ARMENIAN = "աբցդեֆգհիժկլմնոպքրստւվխըյզ"
_MARK = "\u0001"


def kind(entity: Column) -> Column:
    """The type of a found entity."""
    return (F.when(entity.rlike(f"^{_ANNOUNCED}"), "password").when(entity.contains("@"), "email").when(entity.rlike("^AKIA[0-9A-Z]{16}$|^gh[pousr]_|^sk-"), "key")
            .when(entity.rlike("^[0-9]{13,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"), "card")
            .when(entity.rlike(f"^{_HEX}{{32,}}$"), "secret").when(entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(entity.rlike("^[A-Z]{2}[0-9]{2}[ 0-9A-Z]+$"), "iban").when(entity.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
            .when(entity.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(entity.rlike(r"^[+(0-9]"), "phone").otherwise("name"))


def _gender(title: Column) -> Column:
    said = lambda titles: title.rlike(rf"(?:^| )(?:{'|'.join(titles)})\.?(?: |$)")
    return F.when(said(FEMALE_TITLES), "f").when(said(MALE_TITLES), "m").otherwise("n")


def canonical(entity: Column, k: Column) -> Column:
    """What tells one entity of kind ``k`` from another: spelling variants have the same canonical form. A phone number's is its
    national number (the country code stays as it is), a name's its last word, after gender and given names if it has any."""
    title, bare = F.regexp_extract(entity, rf"^({_TITLE}) ", 1), F.lower(F.regexp_replace(entity, rf"^{_TITLE} ", ""))
    return (F.when(k.isin("email", "secret", "ipv6"), F.lower(entity)).when(k.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
            .when(k == "phone", F.regexp_replace(F.regexp_replace(entity, _COUNTRY, ""), "[^0-9]", ""))
            .when(k == "iban", F.regexp_replace(entity, " ", "")).when(k == "password", F.regexp_replace(entity, f"^{_ANNOUNCED}", ""))
            .when(k == "name", F.when(bare.contains(" "), F.concat(_gender(title), F.lit(" "), bare)).otherwise(bare)).otherwise(entity))


def _last(canon: Column) -> Column:
    """The last word of a name's canonical form: the canonical form of the surname alone."""
    return F.substring_index(canon, " ", -1)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def named(found: Column) -> Column:
    """Array of entities -> array of (entity, kind, canon)."""
    kinds = F.transform(found, lambda e: F.struct(e.alias("entity"), kind(e).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["entity"], x["kind"], canonical(x["entity"], x["kind"]).alias("canon")))


def with_surnames(found: Column) -> Column:
    """Array of (entity, kind, canon), and after it the surname of every name of several words as an entity."""
    long = F.filter(found, lambda x: (x["kind"] == "name") & x["canon"].contains(" "))
    alone = lambda last, k: F.struct(F.concat(F.lit("Mr "), last).alias("entity"), k.alias("kind"), last.alias("canon"))
    return F.concat(found, F.transform(long, lambda x: alone(_last(x["canon"]), x["kind"])))


def surrogates(found: Column, key: str, attempt) -> Column:
    """Array of (entity, kind, canon) -> array of surrogates; ``attempt`` gives the attempt of a (kind, canon)."""
    def digest(x: Column) -> Column:
        return F.sha2(F.concat_ws("\u0001", F.lit(key), x["kind"], x["canon"], attempt(x).cast("string")), 512)

    surname = lambda x: F.struct(x["kind"].alias("kind"), _last(x["canon"]).alias("canon"))
    drawn = F.transform(found, lambda x: F.struct(x["entity"], x["kind"], digest(x).alias("h"), (attempt(x) > 0).alias("again"),
                                                  F.when(x["kind"] == "name", _letters(digest(surname(x)))).alias("surname")))
    drawn = F.transform(drawn, lambda x: F.struct(x["entity"], x["kind"], x["h"], _digits(x["h"]).alias("digits"), _letters(x["h"]).alias("letters"),
                                                  x["surname"], x["again"]))
    return F.transform(drawn, lambda x: F.when(x["kind"] == "name", _name(x["entity"], x["h"], x["letters"], x["surname"], x["again"]))
                       .otherwise(_surrogate(x["entity"], x["kind"], x["h"], x["digits"], x["letters"])))


def _digits(digest: Column) -> Column:
    """About 80 uniform decimal digits."""
    return F.translate(digest, "abcdef", "")


def _letters(digest: Column) -> Column:
    return F.translate(digest, "0123456789abcdef", "abdefgiklmnoprtu")


def _filled(shape: Column, digits: Column, letters: Column) -> Column:
    """``shape`` with its digits and ASCII letters replaced one by one; case and all else stay. The digest's digits and letters
    are used again from the start where they do not suffice."""
    one = lambda chars, i: F.substr(chars, (i - 1) % F.length(chars) + 1, F.lit(1))
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        digit, low, up = c.between("0", "9"), c.between("a", "z"), c.between("A", "Z")
        new = F.when(digit, one(digits, acc["i"])).when(low, one(letters, acc["i"])).when(up, F.upper(one(letters, acc["i"]))).otherwise(c)
        return F.struct(F.concat(acc["s"], new).alias("s"), (acc["i"] + (digit | low | up).cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, step)["s"]


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one counting once."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + _luhn_digit(
        F.substr(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))


def _luhn_digit(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def _card(entity: Column, digits: Column) -> Column:
    def checked(filled: Column) -> Column:
        head = F.substr(filled, F.lit(1), F.length(filled) - 1)
        total = _let(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0")), _luhn_sum)
        valid = _let(F.regexp_replace(entity, "[^0-9]", ""), _luhn_sum) % 10 == 0
        return F.when(valid, F.concat(head, ((10 - total % 10) % 10).cast("string"))).otherwise(filled)

    return _let(_filled(entity, digits, digits), checked)


def _byte(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")


def _repeated(chars: Column, n: Column) -> Column:
    """The first ``n`` characters of ``chars`` repeated."""
    return F.substr(F.repeat(chars, F.ceil(n / F.length(chars)).cast("int")), F.lit(1), n)


def _secret(word: Column, digits: Column, letters: Column) -> Column:
    """Same length and shape; a very long one is letters only, as filling costs the square of the length."""
    return F.when(F.length(word) > 512, _repeated(letters, F.length(word))).otherwise(_filled(word, digits, letters))


def _password(word: Column, digits: Column, letters: Column) -> Column:
    """Letters beyond ASCII become ASCII ones. A password of few letters and digits gets 12 letters more, so that there
    are surrogates enough."""
    plain = F.regexp_replace(word, r"[^\x21-\x7E]", "a")
    few = F.length(F.regexp_replace(plain, "[^0-9A-Za-z]", "")) < 8
    return F.concat(_secret(plain, digits, letters), F.when(few, F.substring(letters, 60, 12)).otherwise(""))


def _iban(entity: Column, digits: Column, letters: Column) -> Column:
    """Country and grouping stay, the account is drawn, the check digits hold (remainder 1 by 97)."""
    def checked(account: Column) -> Column:
        moved = F.concat(F.regexp_replace(account, " ", ""), F.substring(entity, 1, 2), F.lit("00"))
        rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97)
                           .otherwise((a * 100 + F.ascii(c) - 55) % 97))
        return F.concat(F.substring(entity, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), account)

    return _let(_filled(F.substr(entity, F.lit(5), F.length(entity)), digits, letters), checked)


def _email(entity: Column, digest: Column, digits: Column, letters: Column) -> Column:
    number = F.regexp_extract(entity, "([._+-]?[0-9]*)@", 1)
    top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(digest, 30) % 3 + 1)
    made = F.concat(F.substring(letters, 1, 12), _filled(number, digits, digits), F.lit("@"), F.substring(letters, 20, 6), F.lit(".example."), top)
    return F.when(entity == F.upper(entity), F.upper(made)).otherwise(made)


def _name(entity: Column, digest: Column, letters: Column, surname: Column, again: Column) -> Column:
    """The surname is drawn for itself; given names are listed ones, from the second attempt on with an ending."""
    title = F.regexp_extract(entity, rf"^({_TITLE}) ", 1)
    gender = _gender(title)
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), _byte(digest, 29) % len(names) + 1)
    words = F.size(F.split(F.regexp_replace(entity, rf"^{_TITLE} ", ""), " "))
    middle = F.transform(F.sequence(F.lit(3), F.greatest(words, F.lit(3))), lambda i: F.concat(F.initcap(F.substr(letters, i * 7 % 110 + 11, F.lit(7))), F.lit(" ")))
    male = (gender == "m") | (gender == "n") & (_byte(digest, 28) % 2 == 0)
    given = F.concat(F.when(male, pick(MALE_NAMES)).otherwise(pick(FEMALE_NAMES)), F.when(again, F.substring(letters, 1, 8)).otherwise(""), F.lit(" "))
    first = F.when(words > 2, F.concat(given, F.array_join(middle, ""))).when(words > 1, given).otherwise("")
    script = lambda text, to: F.translate(text, _LATIN + _LATIN.upper(), to + to.upper())
    made = _let(F.concat(first, F.initcap(F.substring(surname, 1, 10))), lambda m: F.when(entity.rlike(r" \p{IsCyrillic}"), script(m, _CYRILLIC))
                .when(entity.rlike(r" \p{IsGreek}"), script(m, _GREEK)).when(entity.rlike(r" \p{IsArmenian}"), script(m, _ARMENIAN)).otherwise(m))
    return F.concat(title, F.lit(" "), made)


def _surrogate(entity: Column, k: Column, digest: Column, digits: Column, letters: Column) -> Column:
    """The surrogate of an entity that is no name."""
    head = lambda p: F.regexp_extract(entity, p, 0)
    rest = lambda p: F.regexp_replace(entity, p, "")
    octets = [F.lit(1) + _byte(digest, 0) % 223, _byte(digest, 1), _byte(digest, 2), F.lit(1) + _byte(digest, 3) % 254]
    word, prefix = f"^{_ANNOUNCED}", "^(?:AKIA|gh[pousr]_|sk-)"
    hexes = _repeated(digest, F.length(entity))
    area = F.concat(F.translate(F.substring(digits, 1, 1), "01", "27"), F.substring(digits, 2, 60))
    return (F.when(k == "email", _email(entity, digest, digits, letters))
            .when(k == "password", F.concat(head(word), _password(rest(word), digits, letters)))
            .when(k == "key", F.concat(head(prefix), _secret(rest(prefix), digits, letters)))
            .when(k == "secret", F.when(entity == F.upper(entity), F.upper(hexes)).otherwise(hexes))
            .when(k == "iban", _iban(entity, digits, letters))
            .when(k == "phone", F.concat(head(_COUNTRY), _filled(rest(_COUNTRY), area, area)))
            .when(k == "ssn", _filled(entity, digits, digits))
            .when(k == "card", _card(entity, digits))
            .when(k == "ipv6", _filled(entity, digits, F.translate(digest, "0123456789", "abcdefabcd")))
            .otherwise(F.concat_ws(".", *[o.cast("string") for o in octets])))


def pieces(text: Column) -> Column:
    """The text cut at its entities: clear text and entities in turn, beginning and ending with clear text; null for null. One pass
    of the pattern; only a text that holds the mark itself takes two."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    pairs = F.zip_with(F.split(text, PATTERN, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.array(a, b))
    return F.when(text.contains(_MARK), F.slice(F.flatten(pairs), 1, 2 * F.size(found) + 1)).otherwise(marked)


def _odd(cut: Column) -> Column:
    return F.coalesce(F.filter(cut, lambda _, i: i % 2 == 1), F.array().cast("array<string>"))


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return _odd(pieces(text))


def later_attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is not theirs alone, from rows (entity, kind, canon)."""
    known = saved(found.groupBy("kind", "canon").agg(F.min("entity").alias("entity")), "pii-entities")

    def drawn(rows: DataFrame) -> DataFrame:
        made = surrogates(F.array(F.struct("entity", "kind", "canon")), key, lambda _: F.col("attempt"))
        shown = _let(F.element_at(made, 1), lambda m: canonical(m, F.col("kind")))
        # a full name is drawn anew within its surname, which has a row of its own
        full = (F.col("kind") == "name") & F.col("canon").contains(" ")
        return rows.withColumn("s", _let(shown, lambda c: F.when(full, F.concat(F.regexp_replace(c, "[^ ]+$", ""), _last(F.col("canon")))).otherwise(c)))

    names = known.select("kind", F.col("canon").alias("s"))
    given, attempt = saved(drawn(known.withColumn("attempt", F.lit(0))), "pii-drawn"), 0
    while True:
        shared = given.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = given.join(shared, ["kind", "s"]).where((F.col("keep.canon") != F.col("canon")))
        real = given.join(names, ["kind", "s"], "left_semi")
        bad = saved(twice.select("kind", "canon").unionByName(real.select("kind", "canon")).distinct(), "pii-again")
        if bad.isEmpty():
            return given.where("attempt > 0").select("kind", "canon", "attempt")
        attempt += 1
        again = drawn(given.join(bad, ["kind", "canon"], "left_semi").withColumn("attempt", F.lit(attempt)).drop("s"))
        given = saved(given.join(bad, ["kind", "canon"], "left_anti").unionByName(again), "pii-drawn")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the column ``text``. ``found`` names a column to add: array of
    (kind, surrogate) of the replacements in order."""
    cut, e, made, fixes, whole = "__pii_pieces", "__pii_entities", "__pii_made", "__pii_attempts", "__pii_text"
    one = F.explode(with_surnames(F.col(e))).alias("x")
    named_docs = docs.withColumn(e, named(entities(F.col(text))))
    later = saved(later_attempts(named_docs.select(one).select("x.entity", "x.kind", "x.canon"), key), "pii-later")
    rows = docs.withColumn(cut, pieces(F.col(text))).withColumn(e, named(_odd(F.col(cut))))
    attempt = lambda _: F.lit(0)
    if not later.isEmpty():  # a document is known by its whole text here, so ids may repeat or be null
        by = named_docs.select(F.sha2(F.col(text), 256).alias(whole), one).select(whole, "x.kind", "x.canon").distinct().join(later, ["kind", "canon"])
        by = by.groupBy(whole).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "canon"), "attempt"))).alias(fixes))
        rows = rows.withColumn(whole, F.sha2(F.col(text), 256)).join(saved(by, "pii-fixes"), whole, "left")
        attempt = lambda x: F.coalesce(F.element_at(F.col(fixes), F.concat_ws("\u0001", x["kind"], x["canon"])), F.lit(0))
    rows = rows.withColumn(made, F.when(F.size(e) > 0, surrogates(F.col(e), key, attempt)))
    joined = F.array_join(F.transform(F.col(cut), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.element_at(F.col(made), ((i + 1) / 2).cast("int")))), "")
    clean = F.when(F.size(e) > 0, joined).otherwise(F.col(text))
    out = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if found:
        out.append(F.when(F.size(e) > 0, F.zip_with(F.col(e), F.col(made), lambda a, b: F.struct(a["kind"].alias("kind"), b.alias("surrogate")))).alias(found))
    return rows.select(*out)
