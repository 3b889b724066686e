"""Surrogates for personal data, with DataFrame functions only.

Found are e-mail addresses, phone and card numbers, IP addresses, social security numbers, IBANs, secrets, and
persons' names that follow a title or a known given name, or begin with a family name that comes first. Each distinct
entity of the corpus, in its canonical form, gets one surrogate from a keyed digest: of the same kind, length and
punctuation, digits for digits and letters for letters; country codes, the last label of an address and `example` stay;
cards and IBANs keep their check, IPv6 addresses their zeros, tokens their prefix. Names keep gender, script, capitals
and hyphens, but not their length. So mentions in different formats, rows or runs get the same replacement. A name
found once is also replaced where it stands alone in the text, in capitals, in small letters or without its accents
too, unless it is a common word.

Collisions. All distinct entities of a kind (of phones: and a country) are checked together: of those with one surrogate
all but the first, and any whose surrogate is itself an entity of the corpus, are keyed anew, ROUNDS times at most. What
is left then, where a space is nearly full, is dealt among itself: each such entity gets the next one of its form,
country and other parts that stay, in keyed order; where one is left alone, it is exchanged with another of its form. The
exceptions go to their documents by a join on the document; texts are not shuffled unless the exceptions of all
documents are over BROADCAST_BYTES.

The key is the parameter, or the session's spark.tidemill.pii.key; without either it is KEY, which anyone knows.

Defined cases: a null text stays null and has 0 entities; texts are taken whole. Null and repeated doc_ids need no
care, rows are told apart by id and text. Of mentions that start at one place the kinds' order decides. An empty table
gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents_of

KEY = "change-me"
#: Bytes of re-keyed entities, each counted in each of its documents, up to which the join is a broadcast.
BROADCAST_BYTES = 16_000_000
#: Times that colliding entities are keyed anew.
ROUNDS = 8

# Given names that mark a person's name, by gender and script, and titles.
GIVEN = {
    "f_latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Michelle Amanda Melissa Laura Emma Olivia Sophia "
    "Charlotte Alice Julia Maria María Anna Ursula Monika Brigitte Sabine Petra Claudine Sylvie Françoise Nathalie Carmen Dolores Lucía Isabel Priya Anjali Mei Yuki Fatima Aisha Layla Zainab",
    "m_latin": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian George "
    "Edward Peter Hans Jürgen Wolfgang Klaus Stefan Pierre Jacques François Jean Carlos Javier Miguel José Juan Pedro Luis Antonio Amit Rahul Wei Hiroshi Mohammed Ahmed Omar Hassan Khalid Yusuf",
    "f_cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила",
    "m_cyrillic": "Александр Сергей Владимир Дмитрий Андрей Алексей Иван Михаил Николай Павел",
    "f_greek": "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική",
    "m_greek": "Γιώργος Ιωάννης Κώστας Δημήτρης Νίκος Παναγιώτης",
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra", "m": "Mr Herr Monsieur Señor Sr", "n": "Dr Prof"}
#: Family names that come before given names.
FIRST = "Wang Li Zhang Liu Chen Yang Huang Zhao Wu Zhou Kim Choi Nguyen Tran Sato Suzuki Tanaka"
#: Letters with marks and those without that may stand for them.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Names that are common words, and words between names.
COMMON = "May April June August Will Mark Hope Rose Grace Green Brown White Black Young King Hill Wood Stone Field Park Bell Cook Day Fox Long Price Rich Sharp Short Small Winter Baker Page Rivers"
PARTICLES = "van von der den de la del di da dos bin al"
#: Consonants and vowels (one for each hexadecimal digit), and the endings of women's and men's given names.
SOUNDS = {
    "latin": ("bdfghjklmnprstvz", "aaaaeeeeiiiioooo", {"f": "na", "m": "ron"}),
    "cyrillic": ("бвгджзклмнпрстфх", "ааааееееииииоооо", {"f": "на", "m": "рон"}),
    "greek": ("βγδζθκλμνξπρστφχ", "ααααεεεειιιιοοοο", {"f": "να", "m": "ρος"}),
}
HEX = "0123456789abcdef"
CONSONANTS_OF_HEX = "bcdfghklmnprstvz"

# Repetitions are bounded (of an address by what it may have), as a matcher's stack and time are.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{0,62}[\p{L}\p{N}]){1,12}"
IPV4 = rf"(?<!\d\.){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
IPV6 = r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,40}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])"
PHONE = r"(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}(?:[ -]?\(?\d{2,8}\)?){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0\d{3,4}[ -]\d{5,6}|\(0\d{2,4}\) ?\d{3,4}[ -]?\d{3,4})(?!\d|\.\d)"
#: countries' codes; all others have three digits.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
SSN = r"(?:(?<!-)\d{3}-\d{2}-\d{4}|(?<=(?i:ssn|social security)[ :#]{1,3})\d{3} \d{2} \d{4})(?![\d-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<!\d\.)(?:\d{4}(?:[ -]\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{5}|\d{15,16}|4\d{12}|6\d{18})(?![\p{L}\p{N}]|\.\d)"
#: What introduces a secret stays as it is; the secret follows.
NAMED = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
HEXADECIMAL = r"(?=[a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])"
#: Beginnings of well-known tokens.
PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk-|[sr]k_(?:live|test)_|eyJ)"
TOKEN = rf"(?:eyJ[A-Za-z0-9_-]{{8,}}(?:\.[A-Za-z0-9_-]{{8,}}){{1,4}}|(?!eyJ){PREFIX}[A-Za-z0-9-]{{16,}})"
BEARER = r"(?i:bearer)\s{1,3}"
#: The order decides between kinds that start at one place. None starts inside a word, and the first character
#: rules out most kinds at most places.
FOUND = rf"(?<![\p{{L}}\p{{N}}])(?:(?=[\d+(])(?:{IPV4}|{PHONE}|{SSN}|{CARD})|(?=[0-9A-Fa-f])(?:{IPV6}|{HEXADECIMAL})|(?=[tspaTSPA]){NAMED}[^\s\"']{{6,}}|(?=[bB]){BEARER}[A-Za-z0-9._~+/=-]{{16,}}|(?=[Agxsre]){TOKEN}|{EMAIL}|(?=[A-Z]){IBAN})"
#: Every kind has one of these characters, or begins like a token.
NEEDED = "[0-9@=:]|gh[pousr]_|xox[abp]-|sk-|AKIA|ASIA|[sr]k_|eyJ|(?i:bearer)"
SURNAME = rf"(?:(?:{'|'.join(PARTICLES.split())}) ){{0,3}}(?:\p{{Lu}}['’])?\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?"


def _listed(names: str) -> str:
    """Alternatives of a pattern: the names as they are and in capitals."""
    return "|".join([*names.split(), *names.upper().split()])


_GIVEN_ALL = _listed(" ".join(GIVEN.values()))
_TITLE_ALL = _listed(" ".join(TITLES.values()))
PERSON = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLE_ALL})\.? {SURNAME}(?: {SURNAME})?|(?:{_GIVEN_ALL}) {SURNAME}|(?:{_listed(FIRST)}) \p{{Lu}}\p{{L}}+)(?!\p{{L}})"


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _only(m: Column, pattern: str) -> Column:
    return m.rlike(rf"^(?:{pattern})$")


def _kind(m: Column) -> Column:
    return (
        F.when(_only(m, EMAIL), "email").when(_only(m, IPV6), "ipv6").when(_only(m, IPV4), "ipv4").when(_only(m, PHONE), "phone")
        .when(_only(m, r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"), "ssn").when(_only(m, IBAN), "iban").when(_only(m, CARD), "card").otherwise("secret")
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _groups(m: Column) -> list[Column]:
    """The groups of an IPv6 address before and after its ::, if there is one."""
    halves = F.split(F.lower(m), "::")
    return [F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1)]


def _expanded(m: Column) -> Column:
    before, after = (F.transform(g, lambda x: F.lpad(x, 4, "0")) for g in _groups(m))
    return F.array_join(F.concat(before, F.array_repeat(F.lit("0000"), F.lit(8) - F.size(before) - F.size(after)), after), ":")


def _telephone(m: Column) -> Column:
    """Country code (0 if a trunk prefix stands for it), | and the national digits."""
    digits = _digits(m)
    abroad = F.regexp_replace(digits, f"^({COUNTRY})", "$1|")
    return F.when(m.startswith("+"), abroad).when(digits.startswith("0"), F.concat(F.lit("0|"), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(F.concat(F.lit("1|"), digits))


def _canonical(kind: Column, m: Column) -> Column:
    """The form in which mentions of one entity agree."""
    return (
        F.when(kind == "email", F.lower(m)).when(kind == "ipv6", _expanded(m)).when(kind == "phone", _telephone(m))
        .when(kind.isin("card", "ssn"), _digits(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_replace(m, f"^(?:{NAMED}|{BEARER})", "")).otherwise(m)
    )


def _scope(kind: Column, canonical: Column) -> Column:
    """What a surrogate shares with its entity: country, last label or prefix."""
    return (
        F.when(kind == "phone", F.substring_index(canonical, "|", 1)).when(kind == "iban", F.substring(canonical, 1, 2)).when(kind == "email", F.substring_index(canonical, ".", -1))
        .when(kind == "secret", F.regexp_extract(canonical, f"^({PREFIX})?", 0)).otherwise("")
    )


def _national(kind: Column, canonical: Column) -> Column:
    """What of a canonical form a surrogate stands for."""
    return F.when(kind == "phone", F.substring_index(canonical, "|", -1)).otherwise(canonical)


def _entities(text: Column) -> Column:
    """Array of (kind, canonical, match) in the order of the text, without names."""

    def one(m: Column) -> Column:
        return F.struct(_kind(m).alias("kind"), m.alias("match"))

    def full(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), _canonical(e["kind"], e["match"]).alias("canonical"), e["match"].alias("match"))

    none = F.array().cast("array<struct<kind:string,canonical:string,match:string>>")
    return F.when(text.rlike(NEEDED), F.transform(F.transform(_all(text, FOUND), one), full)).otherwise(none)


def bare(name: Column) -> Column:
    """A name in small letters without accents."""
    return F.translate(F.lower(name), MARKED, BARE)


def _names(text: Column) -> Column:
    """Distinct (kind, canonical, match) of the words of persons' names."""
    given = [(k, F.array(*[F.lit(w.lower()) for w in words.split()])) for k, words in GIVEN.items()]

    def script(w: Column) -> Column:
        return F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def parts(m: Column) -> Column:
        words = F.split(m, " ")
        first = F.lower(F.regexp_replace(words[0], r"\.$", ""))
        titled = F.coalesce(*[F.when(F.array_contains(F.array(*[F.lit(t.lower()) for t in names.split()]), first), F.lit(g)) for g, names in TITLES.items()])
        before = titled.isNull() & F.array_contains(F.array(*[F.lit(n.lower()) for n in FIRST.split()]), first)  # the family name
        own = F.when(before, words[1]).when(titled.isNull(), words[0]).otherwise(words[1])
        known = F.coalesce(*[F.when(F.array_contains(names, F.lower(own)), F.lit(k)) for k, names in given])
        spare = F.concat(F.when(titled == "f", "f_").otherwise("m_"), script(F.element_at(words, -1)))
        named = F.when(titled.isNull(), own).when((F.size(words) > 2) & words[1].rlike(r"^\p{Lu}"), words[1])
        family = F.when(before, words[0]).otherwise(F.element_at(words, -1))
        parts = F.filter(F.split(family, "-"), lambda p, i: (F.length(p) > 2) | (F.size(F.split(family, "-")) == 1))
        person = F.transform(parts, lambda p: F.struct(F.concat(F.lit("surname_"), script(p)).alias("kind"), bare(p).alias("canonical"), p.alias("match")))
        given_one = F.struct(F.concat(F.lit("given_"), F.coalesce(known, spare)).alias("kind"), bare(named).alias("canonical"), named.alias("match"))
        return F.when(named.isNotNull(), F.concat(F.array(given_one), person)).otherwise(person)

    return F.array_distinct(F.flatten(F.transform(_all(text, PERSON), parts)))


def _hash(key: str, kind: Column, canonical: Column, attempt: Column, n: int = 0) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"), F.lit(str(n))), 256)


def _decimal(h: Column) -> Column:
    """36 digits of a digest."""
    half = [F.right(F.lpad(F.conv(F.substring(h, at, 15), 16, 10), 19, "0"), F.lit(18)) for at in (1, 16)]
    return F.concat(*half)


def luhn(digits: Column) -> Column:
    """The check sum of a card number; it is valid if this is a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.floor(twice / 10).cast("int") + twice % 10)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _letters(h: Column, at: int, n: int) -> Column:
    return F.translate(F.substring(h, at, n), HEX, CONSONANTS_OF_HEX)


def _sounds(h: Column, script: str, ending: str = "") -> Column:
    consonants, vowels, _ = SOUNDS[script]
    a, b = F.translate(h, HEX, consonants), F.translate(h, HEX, vowels)
    stem = F.concat(*[x for i in (1, 3, 5, 7) for x in (F.substring(a, i, 1), F.substring(b, i + 1, 1))])
    return F.concat(stem, F.lit(ending))


def _core(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """The surrogate in canonical form."""
    return _let(_hash(key, kind, canonical, attempt), lambda h: _let(_decimal(h), lambda digits: _from_digest(key, kind, canonical, attempt, h, digits)))


def _like(text: Column, h: Column, kept: str = "") -> Column:
    """Characters of a digest like the text's: digits for digits, letters of the same case for letters (small ones for
    those of other alphabets), signs for signs; the signs in `kept` stay."""

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(h, F.lit(2) * (i % 32) + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int")

        def of(letters: str) -> Column:
            return F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))

        return F.when(F.lit(kept).contains(c) if kept else F.lit(False), c).when(c.between("0", "9"), of("0123456789")).when(c.between("A", "Z"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"[\p{L}\p{M}\p{N}]"), of("abcdefghijklmnopqrstuvwxyz")).otherwise(of("!#$%&*+-=?^_~"))

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's letters and digits, in the order to be checked."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(canonical: Column, h: Column) -> Column:
    """Country and account letters stay letters; check digits are as far off as they were, right ones right."""
    country = F.substring(canonical, 1, 2)
    own, new = F.substring(canonical, F.lit(5), F.length(canonical)), _like(F.substring(canonical, F.lit(5), F.length(canonical)), h)

    def check(account: Column) -> Column:
        return F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))

    off = F.substring(canonical, 3, 2).cast("int") - check(own)
    return _let(new, lambda n: F.concat(country, F.lpad(F.pmod(check(n) + off, F.lit(100)).cast("string"), 2, "0"), n))


def _email(canonical: Column, h: Column) -> Column:
    labels = F.split(F.substring_index(canonical, "@", -1), r"\.")
    domain = F.transform(labels, lambda x, i: F.when((i == F.size(labels) - 1) | (x == "example"), x).otherwise(_like(x, F.reverse(h), "-")))
    return F.concat(_like(F.substring_index(canonical, "@", 1), h, "._%+-"), F.lit("@"), F.array_join(domain, "."))


def _secret(canonical: Column, h: Column) -> Column:
    """Hexadecimal digits for such, else characters alike; a token's beginning stays."""
    pairs = F.when(canonical.rlike("^[0-9A-F]+$"), F.upper(h)).when(canonical.rlike("^[0-9a-f]+$"), h)
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(canonical) - 1) / 64).cast("int")), lambda i: F.when(i == 0, h).otherwise(F.sha2(F.concat(h, i.cast("string")), 256))), "")
    hexadecimal = F.substring(F.when(canonical.rlike("^[0-9A-F]+$"), F.upper(whole)).otherwise(whole), F.lit(1), F.length(canonical))
    prefix = F.regexp_extract(canonical, f"^({PREFIX})?", 0)
    return F.when(pairs.isNotNull(), hexadecimal).otherwise(F.concat(prefix, _like(F.substring(canonical, F.length(prefix) + 1, F.length(canonical)), h, "._-")))


def _from_digest(key: str, kind: Column, canonical: Column, attempt: Column, h: Column, digits: Column) -> Column:
    size = F.length(canonical)
    national = F.length(_national(kind, canonical))
    phone = F.concat(F.translate(F.substring(digits, 1, 1), "01", "27"), F.substring(digits, F.lit(2), national - 1))
    body = F.concat(F.substring(canonical, 1, 1), F.substring(digits, F.lit(1), size - 2))
    check = ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(luhn(canonical) % 10 == 0, check).otherwise(F.substring(digits, 30, 1)))
    octets = F.concat_ws(".", *[(F.conv(F.substring(h, at, 4), 16, 10).cast("int") % 254 + 1).cast("string") for at in (1, 5, 9, 13)])
    ipv6 = F.array_join(F.transform(F.split(canonical, ""), lambda c, i: F.when(c.isin("0", ":", ""), c).otherwise(F.substring(F.lit("123456789abcdef"), F.conv(F.substring(h, i + 1, F.lit(2)), 16, 10).cast("int") % 15 + 1, F.lit(1)))), "")
    out = (
        F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", F.substring(digits, 1, 9)).when(kind == "ipv4", octets)
        .when(kind == "ipv6", ipv6).when(kind == "email", _email(canonical, h)).when(kind == "iban", _iban(canonical, h)).when(kind == "secret", _secret(canonical, h))
    )
    for script, (_, _, endings) in SOUNDS.items():
        out = out.when(kind == f"surname_{script}", _sounds(h, script))
        for gender, ending in endings.items():
            out = out.when(kind == f"given_{gender}_{script}", _sounds(h, script, ending))
    return out


def _render(kind: Column, match: Column, core: Column) -> Column:
    """The surrogate in the format of the mention."""
    own = _digits(match)
    # digits are put in from the right, so a country code stays
    filled = F.array_join(
        F.transform(
            F.split(match, ""),
            lambda c, i: F.when(
                c.rlike("[0-9]") & (F.length(_digits(F.substring(match, i + 1, F.length(match)))) <= F.length(core)),
                F.substring(core, F.length(core) - F.length(_digits(F.substring(match, i + 1, F.length(match)))) + 1, F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    before, after = _groups(match)
    groups = F.split(core, ":")
    left = F.transform(before, lambda x, i: F.right(F.get(groups, i), F.length(x)))
    right = F.transform(after, lambda x, i: F.right(F.get(groups, F.lit(8) - F.size(after) + i), F.length(x)))
    address = F.concat(F.array_join(left, ":"), F.when(match.contains("::"), "::").otherwise(""), F.array_join(right, ":"))
    spaced = F.when(match.contains(" "), F.rtrim(F.regexp_replace(core, "(.{4})", "$1 "))).otherwise(core)
    shouted = (match == F.upper(match)) & (match != F.lower(match))
    return (
        F.when(kind.isin("phone", "card", "ssn") & (own != ""), filled).when(kind == "iban", spaced)
        .when(kind == "secret", F.concat(F.regexp_extract(match, f"^({NAMED}|{BEARER})?", 0), core))
        .when(kind == "ipv6", F.when(shouted, F.upper(address)).otherwise(address)).when(kind == "email", F.when(shouted, F.upper(core)).otherwise(core))
        .when(kind.startswith("given_") | kind.startswith("surname_"), F.when(shouted & (F.length(match) > 1), F.upper(core)).otherwise(F.initcap(core))).otherwise(core)
    )


def exceptions(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canonical, attempt (from 1) and core of the entities whose first surrogate, or later ones, collided.

    entities: distinct kind and canonical. Each round checks all surrogates against each other and all entities. Where
    ROUNDS didn't do, core is the surrogate: the next such entity of the same form, in keyed order, so all stay distinct.
    An entity that is left alone of its form makes a pair with a settled one, which gives its surrogate up; only where a
    form has no other entity does it keep its last surrogate, or itself where the form has no other value.
    """
    entities = cut(entities.withColumn("scope", _scope(F.col("kind"), F.col("canonical"))))
    own = entities.select("kind", "scope", _national(F.col("kind"), F.col("canonical")).alias("core")).distinct()
    moved = entities.limit(0).drop("scope").withColumn("attempt", F.lit(0))
    for turn in range(ROUNDS + 1):
        now = entities.join(moved, ["kind", "canonical"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        now = cut(now.withColumn("core", _core(key, F.col("kind"), F.col("canonical"), F.col("attempt"))))
        shared = now.groupBy("kind", "scope", "core").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canonical")).alias("first")).where("n > 1")
        later = now.join(shared, ["kind", "scope", "core"]).where(F.struct("attempt", "canonical") > F.col("first")).select("kind", "canonical", "attempt")
        real = now.join(own, ["kind", "scope", "core"], "left_semi").select("kind", "canonical", "attempt")
        again = cut(later.unionByName(real).distinct().withColumn("attempt", F.col("attempt") + 1))
        if turn == ROUNDS or not again.limit(1).count():
            break
        moved = cut(moved.join(again, ["kind", "canonical"], "left_anti").unionByName(again))
    if not again.limit(1).count():
        return moved.withColumn("core", F.lit(None).cast("string"))
    form = F.concat_ws("|", _scope(F.col("kind"), F.col("canonical")), F.regexp_replace(F.regexp_replace(_national(F.col("kind"), F.col("canonical")), r"\d", "9"), r"\p{L}", "a"))
    left = again.withColumn("form", form)
    alone = left.groupBy("kind", "form").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    settled = entities.drop("scope").join(again, ["kind", "canonical"], "left_anti").withColumn("form", form).join(alone, ["kind", "form"])
    partners = settled.groupBy("kind", "form").agg(F.min("canonical").alias("canonical")).withColumn("attempt", F.lit(0))
    left = cut(left.unionByName(partners))
    order = F.sha2(F.concat_ws("|", F.lit(key), F.lit("order"), "kind", "canonical"), 256)
    ring = Window.partitionBy("kind", "form").orderBy(order, "canonical")
    whole = Window.partitionBy("kind", "form").orderBy(order, "canonical").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = _national(F.col("kind"), F.coalesce(F.lead("canonical").over(ring), F.first("canonical").over(whole)))
    dealt = left.withColumn("core", F.when(F.count("*").over(whole) > 1, following)).drop("form")
    return moved.join(left, ["kind", "canonical"], "left_anti").withColumn("core", F.lit(None).cast("string")).unionByName(dealt)


def _id(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.alias("x_doc"), F.xxhash64(text).alias("x_text")]


def _entity_id(kind: Column, canonical: Column) -> Column:
    """Of one length for all entities."""
    return F.sha2(F.concat_ws("|", kind, canonical), 256)


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; n_chars follows the text. Adds n_entities."""
    docs = documents_of(docs)
    key = key or docs.sparkSession.conf.get("spark.tidemill.pii.key", KEY)
    found = docs.select(*_id(F.col("doc_id"), F.col("text")), F.explode(F.concat(_entities(F.col("text")), _names(F.col("text")))).alias("e"))
    moved = exceptions(found.select("e.kind", "e.canonical").distinct(), key)
    tagged = docs
    if moved.limit(1).count():
        mine = found.select("x_doc", "x_text", "e.kind", "e.canonical").distinct().join(moved, ["kind", "canonical"])
        by_doc = cut(mine.groupBy("x_doc", "x_text").agg(F.map_from_entries(F.collect_list(F.struct(_entity_id(F.col("kind"), F.col("canonical")), F.struct("attempt", "core")))).alias("attempts")))
        size = F.aggregate(F.map_values("attempts"), F.lit(0).cast("long"), lambda n, e: n + 100 + F.coalesce(F.octet_length(e["core"]), F.lit(0)))
        small = (by_doc.agg(F.sum(size + 16)).first()[0] or 0) <= BROADCAST_BYTES
        same = F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.xxhash64("text") == F.col("x_text"))
        tagged = docs.join(F.broadcast(by_doc) if small else by_doc, same, "left").drop("x_doc", "x_text")
    else:
        tagged = docs.withColumn("attempts", F.lit(None).cast("map<string,struct<attempt:int,core:string>>"))

    def surrogates(e: Column) -> Column:
        """The surrogates of a mention and of its capitals."""

        def chosen(known: Column) -> Column:
            core = F.coalesce(known["core"], _core(key, e["kind"], e["canonical"], F.coalesce(known["attempt"], F.lit(0))))
            return _let(core, lambda c: F.struct(e["match"].alias("match"), _render(e["kind"], e["match"], c).alias("new"), F.when(e["kind"].rlike("name_|given_"), F.upper(c)).alias("loud")))

        return _let(F.element_at(F.col("attempts"), _entity_id(e["kind"], e["canonical"])), chosen)

    listed = tagged.withColumn("entities", _entities(F.col("text"))).withColumn("names", _names(F.col("text")))
    size, split = F.size("entities"), F.split(F.col("text"), FOUND, -1)
    both = F.transform(F.concat("entities", "names"), surrogates)
    marked = listed.withColumn("new", F.when(size + F.size("names") > 0, both))
    joined = F.array_join(F.transform(split, lambda p, i: F.concat(p, F.coalesce(F.when(i < size, F.get(F.col("new"), i)["new"]), F.lit("")))), "")
    swapped = marked.withColumn("text", F.when(size > 0, joined).otherwise(F.col("text")))
    common = F.array(*map(F.lit, COMMON.split()))

    def rename(text: Column, e: Column) -> Column:
        # a common word only right after what marks a name; such words come first, before given names are replaced
        mark = F.when(F.array_contains(common, e["match"]), F.lit(rf"(?<=(?:{_TITLE_ALL}|{_GIVEN_ALL})\.? )")).otherwise(F.lit(r"(?<!\p{L})"))
        return F.regexp_replace(text, F.concat(mark, e["match"], F.lit(r"(?!\p{L})")), e["new"])

    def rename_loud(text: Column, e: Column) -> Column:
        loud = F.upper(e["match"])
        found = (loud != e["match"]) & text.contains(loud)
        return F.when(found, F.regexp_replace(text, F.concat(F.lit(r"(?<!\p{L})"), loud, F.lit(r"(?!\p{L})")), e["loud"])).otherwise(text)

    def rename_otherwise(text: Column, e: Column) -> Column:
        # without accents, and in small letters with them and without; short ones and common words are left alone
        def put(text: Column, other: Column, new: Column) -> Column:
            found = (other != e["match"]) & text.contains(other)
            return F.when(found, F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}@.])"), other, F.lit(r"(?![\p{L}@])")), new)).otherwise(text)

        plain = F.translate(e["match"], MARKED + MARKED.upper(), BARE + BARE.upper())
        usual = ~F.array_contains(F.transform(common, F.lower), F.lower(e["match"])) & (F.length(e["match"]) > 3)
        quiet = put(put(put(text, plain, e["new"]), F.lower(e["match"]), F.lower(e["new"])), F.lower(plain), F.lower(e["new"]))
        return F.when(usual, quiet).otherwise(text)

    found = F.slice("new", size + 1, F.size("names"))
    names = F.concat(F.filter(found, lambda e: F.array_contains(common, e["match"])), F.filter(found, lambda e: ~F.array_contains(common, e["match"])))
    renamed = F.aggregate(found, F.aggregate(found, F.aggregate(names, F.col("text"), rename), rename_loud), rename_otherwise)
    renamed = swapped.withColumn("text", F.when(F.size("names") > 0, renamed).otherwise(F.col("text")))
    count = (F.size("entities") + F.size("names")).cast("long")
    return renamed.withColumn("n_entities", count).withColumn("n_chars", F.when(count > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns, "n_entities")


def op2(docs: DataFrame) -> DataFrame:
    return replace(docs).select("doc_id", "text", "n_entities")
