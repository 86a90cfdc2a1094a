"""Surrogates for personal data, by DataFrame expressions alone.

Mentions are found by one regular expression a text (e-mail, phone, IPv4, card, social security number, IBAN, secret, person's name in Latin, Cyrillic, Greek or
Han letters). A name is found by an honorific or a known given name; each of its words then counts as a name wherever it stands in the same text.

A mention is made of entities, in a form that its variants share: the words of a name without honorific, the digits of a number without separators and
dialling prefix, an address in lower case. An entity's surrogate is derived from a keyed SHA-512, so that it is the same in every document and variant; it
is put back in the format of each mention. It keeps kind and length: digits for digits, letters of the same case for letters, octets of as many digits, a valid
check digit for a valid card. Known given names are permuted among those of the same gender and script, initials among initials; other words of names become
made-up ones of the same script. A given name that no list holds has the gender of the honorific before it (Mrs. Priya Patel, Mr. Priya Patel): feminine ones
end in a vowel a, masculine ones in a consonant. Without an honorific it has the gender that its own text gives it elsewhere, else the one that all texts agree
on, so that a person keeps one surrogate; where both genders occur it is a name of its own, which ends in a vowel a if the word does. All distinct entities of the corpus are then checked: where two have the same surrogate, or a surrogate is
itself an entity of the corpus, all but the smallest get the next attempt's surrogate, until none collide; texts that hold such entities look the attempt up.

The key is a secret of the caller: whoever has it can tell which surrogate an entity gets. A null text stays null; an empty one empty. Texts without
mentions are unchanged. Repeated rows get the same text. doc_id isn't used, so it may be null or repeat. Other columns are passed on as they are, whatever
their names. What is not found: names that come with neither honorific nor known given name, names in capitals, nicknames, phone numbers without any separator, and
addresses of IP version 6. Chinese names have no gender of their own. Words are found by form alone, so that a capitalised word behind a given name that is a common
word as well (Grace Period), or behind an initial (Grace B. Then), counts as a name. Without a key in the session's settings the query warns and uses a public one.
"""

from __future__ import annotations

import hmac
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, free_name, materialise

#: The session's setting that holds the key of the query and of the pipeline, and the key without it: public, for tests only.
KEY_SETTING, TEST_KEY = "spark.tidemark.pii.key", "not a secret"
#: Attempts that keep length and format exactly.
FREE = 8
#: Bytes of what texts look up (attempts and genders of their entities) that are broadcast at most; more is joined by shuffling.
BROADCAST_BYTES = 8 << 20

# Given names by gender and script, and syllables of made-up words.
FEMALE = "Alice Amelia Anna Barbara Carmen Clara Diana Elena Elizabeth Emily Emma Eva Fatima Grace Hannah Helen Ines Irene Jane Jennifer Julia Karen Laura Lena Linda Lucia Maria Marta Mary Nina Nora Olivia Patricia Paula Rosa Ruth Sara Sarah Sofia Susan Vera".split()
MALE = "Adam Ahmed Albert Ali Andrew Anton Carlos Charles Daniel David Edward Emil Felix Francisco George Henry Hugo Ivan James Johann John Jorge Jose Leon Louis Lucas Mark Martin Michael Mohammed Oscar Paul Peter Richard Robert Simon Stefan Thomas Victor William".split()
FEMALE_CYRILLIC = "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Светлана".split()
MALE_CYRILLIC = "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split()
FEMALE_GREEK = "Αικατερίνη Ανδριάνα Βασιλική Ελένη Ευαγγελία Μαρία Σοφία".split()
MALE_GREEK = "Αντώνης Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Χρήστος".split()
GIVEN = (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC, FEMALE_GREEK, MALE_GREEK)
INITIALS = [c + "." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
LISTED = (*GIVEN, INITIALS)
SYLLABLES = "ba be bo da de di fa fe go ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te va".split()
SYLLABLES_CYRILLIC = "ба бе бо ва ве да де до ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се та те ти ру лу".split()
SYLLABLES_GREEK = "βα βε δα δε κα κε κο λα λε λο μα με μι να νε νο πα πε ρα ρε ρο σα σε τα τε".split()
SURNAMES_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
GIVEN_HAN = "明华强丽敏静伟芳娜杰涛超秀英霞平刚桂文辉"
HONORIFIC_FEMALE = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Госпожа Κυρία".split()
HONORIFIC_MALE = "Mr Mister Sir Herr Monsieur Señor Sr Господин Κύριος Κύριε".split()
HONORIFIC_ANY = "Dr Prof".split()



def _any_of(words: list[str]) -> str:
    """An expression for any of words, by first letter, so that few alternatives are tried at a place; longer ones first."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))


_given = _any_of([n for names in GIVEN for n in names])
#: Given names that two surnames often follow.
_two_surnames = _any_of("Carlos Carmen Elena Francisco Ines Jorge Jose Lucia Maria Marta Patricia Paula Rosa Sara Sofia".split())
_honorific = _any_of(HONORIFIC_FEMALE + HONORIFIC_MALE + HONORIFIC_ANY)
#: O'Neill, McDonald and the like included.
_name_word = r"(?:\p{Lu}[\x27’])?\p{Lu}\p{Ll}{1,30}+(?:\p{Lu}\p{Ll}{1,30}+)?(?!\p{L})"
#: Two words of a hyphenated name at most.
_double = rf"{_name_word}(?:-{_name_word})?"
_initials = r"(?:[A-Z]\. ){0,3}"
_octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_keyword = r"(?:(?i:password|passwd|pwd|token|secret|api_key|apikey|access_key)[\x22']?\s{0,2}[=:]\s{0,2}[\x22']?|(?i:bearer) (?=[A-Za-z+/_.\-]{0,100}[0-9]))"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9_%+.\-])[A-Za-z0-9_%+.\-]++(?<!\.)@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){0,125}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    # the keyword is part of the match and stays
    "secret": _keyword + r"[A-Za-z0-9+/_.\-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.vV]){_octet}(?:\.{_octet}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ \-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{5}))(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,5}\)[ .\-]?)?[0-9]{2,5}(?:[ .\-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    # an honorific stays as it is
    "name": rf"(?<!\p{{L}})(?:(?:{_honorific})\.? {_initials}(?:(?:{_two_surnames}) {_double} {_double}|{_double}(?: {_initials}{_double})?)"
    rf"|(?:{_two_surnames}) {_name_word} {_double}|(?:{_given}) {_initials}{_double})",
    "han": rf"[{SURNAMES_HAN}]\p{{IsHan}}{{1,2}}(?=先生|女士|小姐)",
}
# the first character tells which patterns can match there
_capital = "[A-ZΆ-Я]"  # one range from Greek to Cyrillic: cheaper at each place than exact ones, and the patterns tell
_by_start = [("[0-9+(]", ("ip", "card", "ssn", "phone")), (_capital, ("key", "iban", "name")), ("[ptsabPTSAB]", ("secret",)), ("[一-鿿]", ("han",))]
PATTERN = "|".join([PATTERNS["email"], *(rf"(?={start})(?:{'|'.join(PATTERNS[k] for k in kinds)})" for start, kinds in _by_start)])
#: A text with none of these characters can only hold names and keys.
_MARKS = "[0-9@=:]"
CAPITALS = rf"(?={_capital})(?:{PATTERNS['key']}|{PATTERNS['name']})|(?=[一-鿿]){PATTERNS['han']}"


def kind_of(m: Column) -> Column:
    """The kind of a mention without what stays of it."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^AKIA[0-9A-Z]{16}$"), "key")
        .when(m.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})$"), "card")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3}"), "iban")
        .when(m.rlike(r"^[0-9+(][0-9 ().\-]*$"), "phone")
        .otherwise("name")
    )


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; a column that is used repeatedly would be copied into the plan each time."""
    return F.transform(F.array(value), body)[0]


def _byte(h: Column, i: Column) -> Column:
    """Two bytes of the hash as a number, from place i (cyclic)."""
    return F.conv(F.substring(h, F.pmod(i * 4, F.lit(125)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _mapped(e: Column, h: Column, keep: Column | int = 0, letters: Column | int = 26) -> Column:
    """Each digit and letter of e becomes another of its class; keep: number of leading characters that stay."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(h, i)
        new = F.when(c.between("0", "9"), F.char(F.lit(48) + F.pmod(v, F.lit(10)))).when(c.between("a", "z"), F.char(F.lit(97) + F.pmod(v, F.lit(letters)))).when(c.between("A", "Z"), F.char(F.lit(65) + F.pmod(v, F.lit(26)))).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _pick(values: list[str], v: Column) -> Column:
    return F.split(F.lit(" ".join(values)), " ")[F.pmod(v, F.lit(len(values))).cast("int")]


def _word(e: Column, h: Column, attempt: Column, kind: Column) -> Column:
    """A made-up word of a name, in the same script, with the ending of its gender, else the same kind of ending."""
    places = F.sequence(F.lit(1), F.lit(3) + attempt)

    def made(values: list[str], ending: str, other: str) -> Column:
        body = F.array_join(F.transform(places, lambda i: _pick(values, _byte(h, i))), "")
        return F.initcap(F.concat(body, F.when((kind == "f:") | ((kind == "w:") & e.rlike(f"[{ending}]$")), F.lit(ending[0])).otherwise(_pick(list(other), _byte(h, F.lit(0))))))

    han = F.concat(_pick(list(SURNAMES_HAN), _byte(h, F.lit(0))), F.array_join(F.transform(F.sequence(F.lit(1), F.length(e) - 1 + F.when(attempt > FREE, attempt - FREE).otherwise(0)), lambda i: _pick(list(GIVEN_HAN), _byte(h, i))), ""))
    return F.when(e.rlike(r"\p{IsHan}"), han).when(e.rlike(r"\p{IsCyrillic}"), made(SYLLABLES_CYRILLIC, "ая", "нрвкл")).when(e.rlike(r"\p{IsGreek}"), made(SYLLABLES_GREEK, "αά", "νρσ")).otherwise(made(SYLLABLES, "aá", "nrsl"))


def _ip(e: Column, h: Column, attempt: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        v = _byte(h, i)
        return F.when(attempt > FREE, F.pmod(v, F.lit(256))).when(F.length(o) == 1, F.pmod(v, F.lit(10))).when(F.length(o) == 2, F.pmod(v, F.lit(90)) + 10).otherwise(F.pmod(v, F.lit(156)) + 100).cast("string")

    return F.array_join(F.transform(F.split(e, r"\."), octet), ".")


def _card(e: Column, h: Column) -> Column:
    """The issuer's digit stays; a valid check digit is made valid again."""
    luhn = lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", ""))

    def checked(new: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.substring(new, F.lit(1), F.length(new) - 1), d.cast("string")))
        return F.when(luhn(e), F.filter(ends, luhn)[0]).otherwise(new)

    return _let(_mapped(e, h, F.lit(1)), checked)


def _mod97(digits: Column) -> Column:
    """Of a number whose letters stand for 10 to 35."""
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _iban(e: Column, h: Column) -> Column:
    """The country stays; valid check digits are made valid again."""
    rest = lambda c: F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 2))
    valid = _mod97(F.concat(rest(e), F.substring(e, 3, 2))) == 1

    def checked(new: Column) -> Column:
        check = F.lpad((F.lit(98) - _mod97(F.concat(rest(new), F.lit("00")))).cast("string"), 2, "0")
        return F.when(valid, F.concat(F.substring(new, 1, 2), check, F.substring(new, F.lit(5), F.length(new)))).otherwise(new)

    return _let(_mapped(e, h, F.lit(2)), checked)


def _email(e: Column, h: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    labels = F.size(F.split(domain, r"\."))
    host = F.when(labels > 2, F.concat(_mapped(F.substring_index(domain, ".", 1), F.reverse(h)), F.lit("."))).otherwise(F.lit(""))
    return F.concat(_mapped(local, h), F.lit("@"), host, F.lit("example."), F.substring_index(domain, ".", -1))


def _lists(key: str) -> dict[str, str]:
    """Each known given name, and each initial, with the one that stands for it: the next of its list in an order that the key gives."""
    out = {}
    for names in LISTED:
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), "sha512").digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


_PREFIXES = {"email": "e:", "key": "k:", "ip": "a:", "ssn": "n:", "card": "c:", "iban": "i:", "phone": "p:", "secret": "s:", "name": "w:"}
_KNOWN_UNITS = [_PREFIXES["name"] + n for names in LISTED for n in names]
#: Prefixes of given names by the honorific before them.
_FEMININE, _MASCULINE = "f:", "m:"
_GENDERS = (_FEMININE, _MASCULINE)


def _split(mention: Column, body) -> Column:
    """body(stays, rest, kind): the keyword before a secret or the honorific, what is replaced, and its kind."""
    keyword = F.regexp_extract(mention, "^" + _keyword, 0)

    def inner(k: Column) -> Column:
        title = F.regexp_extract(mention, rf"^(?:{_honorific})\.? (?=\p{{Lu}})", 0)
        return _let(F.when(k != "", k).otherwise(title), lambda stays: _let(F.substring(mention, F.length(stays) + 1, F.length(mention)), lambda rest: _let(F.when(k != "", "secret").otherwise(kind_of(rest)), lambda kind: body(stays, rest, kind))))

    return _let(keyword, inner)


def _dial(e: Column) -> Column:
    return F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[^0-9])", 0)


def _words(rest: Column) -> Column:
    return F.split(rest, "[ -]")


def _prefix(unit: Column) -> Column:
    return F.substring(unit, 1, 2)


def _form(unit: Column) -> Column:
    return F.substring(unit, F.lit(3), F.length(unit))


def _ungendered(unit: Column) -> Column:
    return F.when(_prefix(unit).isin(*_GENDERS), F.concat(F.lit(_PREFIXES["name"]), _form(unit))).otherwise(unit)


def _name_units(stays: Column, rest: Column) -> Column:
    """The words of a name; the first of several is a given name, which has the gender of the honorific if no list knows it."""
    honorific = lambda titles: stays.rlike(rf"^(?:{_any_of(titles)})\.? $")
    plain = F.transform(_words(rest), lambda w: F.concat(F.lit(_PREFIXES["name"]), w))

    def gendered(gender: Column) -> Column:
        return F.transform(plain, lambda u, i: F.when((i == 0) & ~u.isin(_KNOWN_UNITS), F.concat(gender, _form(u))).otherwise(u))

    several = rest.contains(" ")
    return F.when(several & honorific(HONORIFIC_FEMALE), gendered(F.lit(_FEMININE))).when(several & honorific(HONORIFIC_MALE), gendered(F.lit(_MASCULINE))).otherwise(plain)


def described(mention: Column) -> Column:
    """A mention as what stays (the keyword before a secret, an honorific), the rest, its kind, and its units: the words of a name, else the one entity, each
    as its kind's prefix and the form that variants share."""

    def of(stays: Column, rest: Column, kind: Column) -> Column:
        bare = F.regexp_replace(rest, "[^0-9A-Za-z]", "")
        prefix = F.coalesce(*[F.when(kind == k, v) for k, v in _PREFIXES.items()])
        form = F.when(kind == "email", F.lower(rest)).when(kind.isin("ssn", "card", "iban"), bare).when(kind == "phone", F.regexp_replace(F.substring(rest, F.length(_dial(rest)) + 1, F.length(rest)), "[^0-9]", "")).otherwise(rest)
        units = F.when(kind == "name", _name_units(stays, rest)).otherwise(F.array(F.concat(prefix, form)))
        return F.struct(stays.alias("stays"), rest.alias("rest"), kind.alias("kind"), units.alias("units"))

    return _split(mention, of)


def with_genders(found: Column) -> Column:
    """Described mentions of one text, where a word that has one gender somewhere has it everywhere."""
    given = F.array_distinct(F.filter(F.flatten(F.transform(found, lambda m: m["units"])), lambda u: _prefix(u).isin(*_GENDERS)))

    def resolved(given: Column) -> Column:
        def unit(u: Column) -> Column:
            has = lambda gender: F.array_contains(given, F.concat(F.lit(gender), _form(u)))
            named = lambda gender: F.concat(F.lit(gender), _form(u))
            f, m = has(_FEMININE), has(_MASCULINE)
            return F.when(_prefix(u) != _PREFIXES["name"], u).when(f & ~m, named(_FEMININE)).when(m & ~f, named(_MASCULINE)).otherwise(u)

        return F.when(F.size(given) > 0, F.transform(found, lambda m: m.withField("units", F.transform(m["units"], unit)))).otherwise(found)

    return _let(given, resolved)


def entities(found: Column) -> Column:
    """The distinct entities of described mentions: all units but known given names, which have their own list."""
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda m: m["units"])), lambda u: ~u.isin(_KNOWN_UNITS)))


def surrogate(entity: Column, attempt: Column, key: str) -> Column:
    """Of an entity, in the form that its variants share, without kind."""

    def hashed(entity: Column, attempt: Column) -> Column:
        return _let(F.sha2(F.concat_ws("\x1f", F.lit(key), entity, attempt.cast("string")), 512), lambda h: _let(F.substring(entity, 3, F.length(entity)), lambda e: _let(F.substring(entity, 1, 2), lambda kind: _let(_made(e, attempt, kind, h), lambda made: _longer(attempt, kind, h, made)))))

    return _let(entity, lambda entity: _let(attempt, lambda attempt: hashed(entity, attempt)))


def _made(e: Column, attempt: Column, kind: Column, h: Column) -> Column:
    keep = F.when(kind == "k:", 4).otherwise(0)
    letters = F.when((kind == "s:") & e.rlike("^[0-9a-f]+$"), 6).otherwise(26)
    return (
        F.when(kind.isin("w:", *_GENDERS), _word(e, h, attempt, kind))
        .when(kind == "e:", _email(e, h))
        .when(kind == "a:", _ip(e, h, attempt))
        .when(kind == "c:", _card(e, h))
        .when(kind == "i:", _iban(e, h))
        .otherwise(_let(keep, lambda keep: _let(letters, lambda letters: _mapped(e, h, keep, letters))))
    )


def _longer(attempt: Column, kind: Column, h: Column, made: Column) -> Column:
    """A format that has no free values left (say, one-letter addresses) grows by a few characters."""
    more = F.substring(h, F.lit(1), attempt)
    as_is = (attempt <= FREE) | kind.isin("w:", *_GENDERS) | ((kind == "a:") & (attempt <= 4 * FREE))
    return F.when(as_is, made).when(kind == "e:", F.concat(more, made)).otherwise(F.concat(made, F.lit("-"), more))


def _put_back(rest: Column, made: Column) -> Column:
    """made, a run of digits and letters, with the separators of rest; what made has more is added behind."""
    places = F.transform(F.split(rest, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(made, F.length(F.regexp_replace(F.substring(rest, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    used = F.length(F.regexp_replace(rest, "[^0-9A-Za-z]", ""))
    return F.concat(F.array_join(places, ""), F.substring(made, used + 1, F.length(made)))


def replacement(m: Column, found_of, key: str) -> Column:
    """What stands for a described mention. found_of(unit): the entity it is and that one's attempt, null for itself and the first."""
    listed = F.create_map(*[F.lit(x) for name, other in _lists(key).items() for x in (_PREFIXES["name"] + name, other)])
    own = lambda u: _let(found_of(u), lambda hit: surrogate(F.coalesce(hit["entity"], u), F.coalesce(hit["attempt"], F.lit(0)), key))
    made = F.transform(m["units"], lambda u: F.coalesce(F.try_element_at(listed, u), own(u)))

    def shown(all_: Column) -> Column:
        rest, kind, new = m["rest"], m["kind"], all_[0]
        gaps = F.split(F.regexp_replace(rest, "[^ -]+", "x"), "x")
        name = F.array_join(F.zip_with(all_, F.slice(gaps, 2, F.size(gaps) - 1), lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
        dial, local = _dial(rest), F.substring_index(rest, "@", 1)
        cased = F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
        as_long = F.length(F.substring_index(new, "@", 1)) == F.length(local)
        email = F.when(as_long & rest.rlike("[A-Z]"), F.concat(cased, F.lit("@"), F.substring_index(new, "@", -1))).otherwise(new)
        number = F.concat(dial, _put_back(F.substring(rest, F.length(dial) + 1, F.length(rest)), new))  # only phones have a dialling prefix
        return F.when(kind == "name", name).when(kind == "email", email).when(kind.isin("phone", "ssn", "card", "iban"), number).otherwise(new)

    return F.concat(m["stays"], _let(made, shown))


def general_pattern(text: Column) -> Column:
    """By what the text can hold; null where nothing can be found."""
    return F.when(text.rlike(_MARKS), PATTERN).when(text.rlike(CAPITALS), CAPITALS)


def name_words(found: Column) -> Column:
    """Alternatives for the words of the names among described mentions, the longer ones first, so that none hides another."""
    units = entities(F.filter(found, lambda m: m["kind"] == "name"))
    ordered = F.reverse(F.array_sort(F.transform(units, lambda u: F.struct(F.length(u).alias("n"), F.substring(u, 3, F.length(u)).alias("w")))))

    def alternatives(words: Column) -> Column:
        han, other = F.filter(words, lambda w: w.rlike(r"\p{IsHan}")), F.filter(words, lambda w: ~w.rlike(r"\p{IsHan}"))
        # looked for at capital letters only
        cased = F.when(F.size(other) > 0, F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?:"), F.array_join(other, "|"), F.lit(r")(?!\p{L})")))
        return F.concat_ws("|", cased, F.when(F.size(han) > 0, F.array_join(han, "|")))

    return _let(F.transform(ordered, lambda x: x["w"]), alternatives)


def with_mentions(docs: DataFrame, general: str, found: str, words: str, pattern: str) -> DataFrame:
    """docs with columns of these names: the pattern of each text's mentions and the described mentions in order, repeats included; null without any."""
    text = F.col("text").cast("string")
    describe = lambda p: F.transform(F.regexp_extract_all(text, p, F.lit(0)), described)
    own = docs.withColumn(general, general_pattern(text)).withColumn(found, describe(F.col(general))).withColumn(words, name_words(F.col(found)))
    own = own.withColumn(pattern, F.when(F.col(words) != "", F.concat(F.col(general), F.lit("|"), F.col(words))).otherwise(F.col(general)))
    return own.withColumn(found, with_genders(F.when(F.col(words) != "", describe(F.col(pattern))).otherwise(F.col(found)))).drop(general, words)


def named_entities(seen: DataFrame) -> DataFrame:
    """seen: unit, repeats included. (unit, entity): a word without gender is the given name that has the only gender of the word in all texts; all else is itself.
    Rows with unit = entity hold each entity once."""
    by_form = seen.groupBy(_ungendered(F.col("unit")).alias("form")).agg(*[F.max(_prefix(F.col("unit")) == g).alias(g[0]) for g in _GENDERS], F.max(~_prefix(F.col("unit")).isin(*_GENDERS)).alias("plain"))
    word = _form(F.col("form"))
    f, m = (F.concat(F.lit(g), word) for g in _GENDERS)
    pair = lambda unit, entity: F.struct(unit.alias("unit"), entity.alias("entity"))
    both = F.when(F.expr("f and not m"), f).when(F.expr("m and not f"), m).otherwise(F.col("form"))
    pairs = F.array(F.when(F.col("plain"), pair(F.col("form"), both)), F.when(F.col("f"), pair(f, f)), F.when(F.col("m"), pair(m, m)))
    return by_form.select(F.inline(F.array_compact(pairs)))


def attempts(distinct: DataFrame, key: str) -> DataFrame:
    """distinct: entity. (entity, attempt) of the entities whose first surrogate collides; the final ones collide with nothing."""
    state = materialise(distinct.select("entity", F.lit(0).alias("attempt")), "pii-attempt")
    while True:
        # a name collides with a name, whatever their genders
        kind = _prefix(_ungendered(F.col("entity")))
        made = state.select("entity", "attempt", F.concat(kind, surrogate(F.col("entity"), F.col("attempt"), key)).alias("made"))
        made = materialise(made, "pii-made")
        real = distinct.select(_ungendered(F.col("entity")).alias("made"))
        first = made.groupBy("made").agg(F.min(F.struct("attempt", "entity")).getField("entity").alias("owner"), F.count(F.lit(1)).alias("n"))
        twice = made.join(first.where("n > 1"), "made").where("entity <> owner").select("entity")
        taken = made.join(real, "made", "left_semi").select("entity").unionByName(made.where(F.col("made").isin(_KNOWN_UNITS)).select("entity"))
        bad = materialise(twice.unionByName(taken).distinct(), "pii-bad")
        forget(made)
        if bad.isEmpty():
            return state.where("attempt > 0")
        moved = materialise(state.join(bad.withColumn("again", F.lit(1)), "entity", "left").select("entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "pii-attempt")
        forget(state, bad)
        state = moved


def replace_pii(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """docs with text replaced and one more column, the number of mentions; and the name of that column."""
    text = F.col("text").cast("string")
    number, general, found, words, pattern, again_, hash_, own_hash = (free_name(docs, f"pii_{n}") for n in ("entities", "general", "found", "words", "pattern", "again", "hash", "own_hash"))
    own = with_mentions(docs, general, found, words, pattern)
    # by a text's hash: where two texts share one, each only knows of entities of the other as well
    # (the outer form, since a filter before the plain one would look for all mentions a second time)
    seen = own.select(F.xxhash64(text).alias("hash"), F.explode_outer(entities(F.col(found))).alias("unit")).where("unit is not null")
    seen = materialise(seen.distinct(), "pii-found")
    named = materialise(named_entities(seen.select("unit")), "pii-named")
    later = materialise(attempts(named.where("unit = entity").select("entity"), key), "pii-again")
    again = materialise(named.join(later, "entity", "left").where("unit <> entity or attempt is not null").select("unit", "entity", "attempt"), "pii-other")
    if again.isEmpty():
        own = own.withColumn(again_, F.lit(None).cast("map<string,struct<entity:string,attempt:int>>"))
    else:
        of_text = F.map_from_entries(F.collect_list(F.struct("unit", F.struct("entity", "attempt"))))
        size = F.sum(F.octet_length("unit") + F.octet_length("entity") + 32) + 64
        by_text = seen.join(again, "unit").groupBy("hash").agg(of_text.alias(again_), size.alias("bytes")).withColumnRenamed("hash", hash_)
        by_text = materialise(by_text, "pii-by-text")
        small = by_text.agg(F.sum("bytes")).first()[0] <= BROADCAST_BYTES
        by_text = by_text.drop("bytes")
        own = own.withColumn(own_hash, F.xxhash64(text)).join(F.broadcast(by_text) if small else by_text, F.col(own_hash) == F.col(hash_), "left").drop(hash_, own_hash)
    made = F.transform(found, lambda m: replacement(m, lambda u: F.try_element_at(F.col(again_), u), key))
    between = F.split(text, F.col(pattern), -1)
    pieces = F.zip_with(between, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    new = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)
    return own.withColumns({"text": new, number: F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0))}).drop(pattern, found, again_), number


def redact_documents(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced; n_chars, if there is one, is that of the new text."""
    out, _ = replace_pii(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def key_of(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a public key, so anyone can tell which entity has which", stacklevel=2)
    return key or TEST_KEY


def digest(done: tuple[DataFrame, str]) -> DataFrame:
    return done[0].select("doc_id", F.col(done[1]).alias("n_entities"), "text")


QUERY = lambda spark, sf_dir: digest(replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), key_of(spark)))
