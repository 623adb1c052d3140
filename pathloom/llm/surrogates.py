"""PII: surrogate generation, in DataFrame functions only.

One pattern finds entities (e-mail, phone, IP address, payment card, social security number, IBAN,
secret, person) from left to right, in one scan whose result is kept as a table. Persons are found by a title, by a first
name of a broad table before a capitalised word, or by a cue ("my name is"); in texts that name someone, the
same names are then found alone too. Each mention falls into entities: a person into given names and
family name, everything else is one. An entity has a canonical form by type (digits of a phone with its country code, digits of
a card, lower case of an e-mail, ...), so that spellings of one entity share one surrogate.

A surrogate is drawn with a keyed SHA-256 and has the form of what it replaces: digits for digits, letters of the same script
and case for letters, names of the same gender and script for names, valid check digits for cards and IBANs; it is
then written in the mention's own format. Distinct entities keep distinct surrogates: draws that fall on each
other, on a surrogate given before or on an entity of the corpus are drawn again (all but the smallest
entity), round by round, until none collide. As given and family names have surrogates of their own, "Mrs Anna Ashley", "Anna
Ashley" and "Ashley" stay one person.

The key comes from the caller or from ``spark.pathloom.surrogates.key``; without either one is drawn for the application, so
that nobody can repeat the draws (it is part of the query plan: event logs must be as secret as the key).

Limits: a person with neither title, cue nor a first name of the table is not found; any number of 13 to 19 digits counts as
a card; initials stay.

Texts with entities meet their surrogates by a hash of the text, so copies are replaced alike; hot texts and hot entities
(over a thousandth of the rows, so at most a thousand) are joined by broadcast.

Defined results: null and empty texts are left as they are; very long texts are scanned whole; repeated
rows and ties get the same surrogates; an empty table gives an empty result; all other columns are kept,
whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind_text, discard, join_hot, keep, once, table

KEY_CONF = "spark.pathloom.surrogates.key"
_DRAWN_KEYS: dict[str, str] = {}

HEX = "[0-9A-Fa-f]{1,4}"
END = r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![._%+\-])[\p{L}\p{N}._%+\-]++@(?=[\p{L}\p{N}\-]++\.[\p{L}\p{N}])[\p{L}\p{N}.\-]*[\p{L}\p{N}]"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}{END}(?!\.\p{{N}})"
IP6 = rf"(?<!:)(?=[0-9A-Fa-f:]{{0,40}}\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{2,6}}(?::{HEX}){{1,5}}|{HEX}:(?::{HEX}){{2,6}})(?![\p{{L}}\p{{N}}:])"
PHONE = (
    r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}"
    rf"|[2-9]\d\d \d{{3}} \d{{4}}(?! ?\d)|0\d{{1,4}}[ /\-]\d{{5,8}}){END}"
)
SSN = rf"(?<!-)\d{{3}}-\d{{2}}-\d{{4}}(?!-){END}"
CARD = rf"\d(?:[ \-]?\d){{12,18}}{END}"
IBAN = rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{END}"
PREFIX = "(?:sk|pk|ghp|xoxb|AKIA)"
SECRET = rf"(?:[0-9a-f]{{24,}}|[0-9A-F]{{24,}}|{PREFIX}[_\-]?[A-Za-z0-9_\-]{{16,}}){END}"
#: a value with a digit after password= and the like
ASSIGNED = (
    r"(?=[^\s\d]{0,60}\d)(?<=(?i:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)"
    r"[A-Za-z0-9+/_.~\-]{5,}[A-Za-z0-9=]"
)

#: (script, gender) -> first names; f, m or u (either)
FIRST = {
    ("latin", "f"): (
        "Alice Amanda Amelia Amy Andrea Angela Anna Anne Barbara Beatrice Betty Carla Carmen Carol Caroline Catherine Charlotte Christina Clara Deborah Diana Donna Elena Elizabeth "
        "Ella Emily Emma Eva Eleanor Fatima Françoise Gabriele Grace Hannah Heike Helen Helga Ingrid Irene Isabel Isabella Jane Janet Jennifer Jessica Joan Johanna Julia Karen Katharina "
        "Katherine Kathleen Laura Lea Lena Linda Lisa Lucia Lucy Margaret María Maria Marie Marta Martha Mary Megan Melissa Michelle Monica Monika Nancy Natalia Nicole Nina Nora Olga Olivia "
        "Pamela Patricia Paula Petra Pilar Rachel Rebecca Renate Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Sofia Sophie Stephanie Susan Susanne Teresa Theresa Tatiana Ursula Valentina Victoria Virginia Yvonne Zoe"
    ),
    ("latin", "m"): (
        "Aaron Adam Alan Albert Alejandro Alexander Alfred Andreas Andrew Anthony Antonio Arthur Benjamin Bernard Brian Carlos Charles Christian Christopher Daniel David Dennis Diego Dmitri Donald "
        "Edward Eric Ernst Felix Fernando Francis Francisco François Frank Franz Fred Friedrich Gary George Georg Gerald Gregory Günter Hans Harold Harry Heinrich Henry Hugo Ivan Jack Jacob Jacques "
        "James Jason Javier Jean Jeffrey Jeremy Johannes John Jonathan Jorge Joseph José Joshua Juan Julian Jürgen Karl Kenneth Kevin Klaus Larry Lars Laurent Louis Luca Ludwig Luis Manuel Marco Marcus Mario "
        "Martin Matthew Max Michael Michel Miguel Nathan Nicholas Nikolai Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Ralph Raymond Richard Robert Roger Roland Ronald Rudolf "
        "Samuel Scott Sebastian Sergei Simon Stefan Stephen Steven Thomas Timothy Tobias Victor Vladimir Walter Werner William Wolfgang"
    ),
    ("latin", "u"): "Alex Andy Casey Chris Dominique Jamie Jordan Kim Morgan Nicola Robin Sam Sasha Taylor Terry",
    ("cyrillic", "f"): "Александра Алла Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Марина Мария Надежда Наталья Нина Оксана Ольга Светлана София Татьяна Юлия",
    ("cyrillic", "m"): "Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Василий Виктор Владимир Дмитрий Евгений Иван Игорь Кирилл Константин Максим Михаил Николай Олег Павел Пётр Роман Сергей Фёдор Юрий",
    ("cyrillic", "u"): "Женя Саша",
    ("greek", "f"): "Αικατερίνη Άννα Βασιλική Γεωργία Δέσποινα Ελένη Ευαγγελία Ιωάννα Κατερίνα Μαρία Σοφία",
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Βασίλης Γεώργιος Γιάννης Γιώργος Δημήτρης Ιωάννης Κωνσταντίνος Κώστας Νίκος Παναγιώτης Πέτρος",
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Signora Lady Госпожа Κυρία",
    "m": "Mr Herr Herrn Monsieur Señor Sr Signor Sir Lord Господин Κύριος",
    "u": "Dr Prof Professor Doctor Rev Доктор Профессор",
}
#: what makes a first name before it no person ("Grace Period")
NOUNS = (
    "Academy Allee Avenue Award Bay Beach Bridge Canal Castle Center Centre Chapel Church City Club College County Court Creek Cup Day Drive Fall Falls Foundation Garden Gardens Gasse Haus Hall High Hill Hospital "
    "Hotel House Institute Island Kirche Lake Lane Library Memorial Mountain Museum Palace Park Period Place Platz Plaza Port Prize Pub Rathaus River Road Schule Society Spring Springs Square Station Strasse Straße "
    "Street Summer Theater Theatre Tower University Valley Village Week Weg Winter"
)
#: first names that are words too: alone they are no mention of a person
WORDS = "Grace Carol Max Frank Sandra Rosa Marie Jordan Robin Art Mark Will May Rose Hope Faith June April Victoria Virginia Georgia Clara"
NEXT = r"\p{Lu}[\p{L}\p{M}'’\-]*[\p{L}\p{M}]"
_either = lambda words: "(?:" + "|".join(sorted(set(words.split()), key=lambda w: (-len(w), w))) + ")"
TITLE = rf"{_either(' '.join(TITLES.values()))}\.? "
KNOWN = _either(" ".join(FIRST.values()))
CUE = r"(?<=(?:[Mm]y name is|[Nn]ame:|[Rr]egards,|[Ss]incerely,|[Ss]igned by)\s)"
NAME = (
    rf"(?=\p{{Lu}})(?:{TITLE}(?:(?:{NEXT}|\p{{Lu}}\.) ){{0,2}}{NEXT}|{KNOWN} (?:(?:{NEXT}|\p{{Lu}}\.) )?(?!{_either(NOUNS)}(?!\p{{L}})){NEXT}|{CUE}{NEXT}(?: {NEXT}){{1,2}})(?!\p{{L}})"
)
BEGIN = r"(?<![\p{L}\p{N}])"
PATTERN = f"{BEGIN}(?:{'|'.join((EMAIL, IP, IP6, SSN, PHONE, CARD, IBAN, SECRET, ASSIGNED, NAME))})"
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщьыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЬЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
CLASSES = (r"\p{Nd}", r"[\p{Ll}&&\p{IsLatin}]", r"[\p{Lu}&&\p{IsLatin}]", r"[\p{Ll}&&\p{IsCyrillic}]", r"[\p{Lu}&&\p{IsCyrillic}]", r"[\p{Ll}&&\p{IsGreek}]", r"[\p{Lu}&&\p{IsGreek}]")
#: beginnings and ends that names are drawn from: (kind, script, gender)
SYLLABLES = {
    ("given", "latin", "f"): ("Al Bel Cor Da El Fi Gi Ha Is Jo Ka Li Mi No Ro Sa Ta Vi", "da ina elle ette ia essa lyn na"),
    ("given", "latin", "m"): ("Al Ber Cor Da El Fa Gar Ha Is Jo Ka Le Mi No Ro Sa Ta Vi", "dan den do rus bert vin rard ron"),
    ("given", "latin", "u"): ("Al Bel Cor Da El Fa Gar Ha Jo Ka Le Mi No Ro Sa Ta", "ry lie ne ri sey ley"),
    ("given", "cyrillic", "f"): ("Ал Бе Ве Да Зо Ка Ли Ми На Ро Са Та", "на рина лия ша дия"),
    ("given", "cyrillic", "m"): ("Ал Бе Ве Да Зо Ка Ли Ми На Ро Са Та", "дан рислав мир рон тей"),
    ("given", "cyrillic", "u"): ("Ал Бе Ве Да Зо Ка Ли Ми", "ня ша ся"),
    ("given", "greek", "f"): ("Αλ Βα Δη Ελ Κα Λι Μα Νι Ρο Σο", "νία ρούλα λένη"),
    ("given", "greek", "m"): ("Αλ Βα Δη Ελ Κα Λι Μα Νι Ρο Σο", "νος ρης λας"),
    ("given", "greek", "u"): ("Αλ Βα Δη Ελ Κα Λι Μα Νι Ρο Σο", "νι ρι"),
    ("family", "latin", "u"): ("Ash Bel Cor Dun El Far Gar Hart Kel Lang Mar Nor Pen Rad Sel Tor Wes", "ley ton man well ford ham by son"),
    ("family", "cyrillic", "f"): ("Бел Вол Гор Дол Каз Лаз Мор Нов Сав Тар", "ова ева ина"),
    ("family", "cyrillic", "m"): ("Бел Вол Гор Дол Каз Лаз Мор Нов Сав Тар", "ов ев ин"),
    ("family", "cyrillic", "u"): ("Бел Вол Гор Дол Каз Лаз Мор Нов Сав Тар", "енко чук"),
    ("family", "greek", "f"): ("Παπα Γεωργ Νικολ Δημ Καρ Λαμ", "άκη ίδου οπούλου"),
    ("family", "greek", "m"): ("Παπα Γεωργ Νικολ Δημ Καρ Λαμ", "άκης ίδης όπουλος"),
    ("family", "greek", "u"): ("Παπα Γεωργ Νικολ Δημ Καρ Λαμ", "έα ού"),
}
#: ends by which a family name has a gender
GENDERED = {"f": "(?:ова|ева|ёва|ина|ая|άκη|ίδου|οπούλου|ού)$", "m": "(?:ов|ев|ёв|ин|ий|ος|ης|ας)$"}
CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def session_key(spark: SparkSession) -> str:
    """The key that the session names, or one drawn for this application."""
    named = spark.conf.get(KEY_CONF, None)
    return named or _DRAWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum's last digit; 0 is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def kind_of(m: Column) -> Column:
    """The type of a mention."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    kinds = [
        (F.contains(m, F.lit("@")), "email"), (whole(IP) | whole(IP6), "ip"), (whole(SSN), "ssn"), (whole(PHONE), "phone"), (whole(CARD), "card"),
        (whole(SECRET), "secret"), (whole(IBAN), "iban"), (~m.rlike(r"^[\p{L}\p{M} .'’\-]+$"), "secret"),
    ]
    out = F
    for holds, kind in kinds:
        out = out.when(holds, kind)
    return out.otherwise("name")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _title(m: Column) -> Column:
    """A name's title with its dot and space."""
    return F.regexp_extract(m, f"^(?:{TITLE})?", 0)


def _title_gender(m: Column) -> Column:
    """f or m, NULL where there is no title that tells."""
    out = F
    for g in "fm":
        out = out.when(m.rlike(rf"^{_either(TITLES[g])}\.? "), g)
    return out


def _table_gender(word: Column) -> Column:
    out = F
    for (_, g), names in FIRST.items():
        out = out.when(word.rlike(f"^{_either(names)}$"), g)
    return out


def _name_words(m: Column) -> Column:
    return F.split(F.substring(m, F.length(_title(m)) + 1, F.length(m)), " ")


def given_entity(word: Column, gender: Column) -> Column:
    return F.concat(_script(word), F.lit(" "), F.coalesce(_table_gender(word), gender, F.lit("u")), F.lit("|"), F.lower(word))


def family_entity(word: Column) -> Column:
    low = F.lower(word)
    gender = F.when(_script(word) == "latin", "u").when(low.rlike(GENDERED["f"]), "f").when(low.rlike(GENDERED["m"]), "m").otherwise("u")
    return F.concat(_script(word), F.lit(" "), gender, F.lit("|"), low)


def canonical(kind: Column, m: Column) -> Column:
    """The entity behind a mention that is no name."""
    digits = _digits(m)
    phone = F.when(~F.startswith(m, F.lit("+")) & (F.length(digits) == 10) & ~F.startswith(m, F.lit("0")), F.concat(F.lit("1"), digits)).otherwise(digits)
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip"), F.lower(m))
        .otherwise(m)
    )


def _stream(entity: Column, attempt: Column, key: str) -> Column:
    """512 keyed hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), entity, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat_ws("\x1f", seed, F.lit(str(k))), 256) for k in range(8)))


def _draw(stream: Column, at: Column) -> Column:
    """The number 0..65535 at a place of the stream (places go round)."""
    return F.conv(F.substring(stream, F.pmod(at, F.lit(127)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], stream: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _draw(stream, F.lit(at)) % len(values) + 1)


def scramble(m: Column, stream: Column) -> Column:
    """Each letter and digit by one of its script and case."""

    def one(i: Column) -> Column:
        c, n, out = F.substring(m, i, F.lit(1)), _draw(stream, i), F
        for cls, letters in zip(CLASSES, ALPHABETS):
            out = out.when(c.rlike(cls), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.when(F.length(m) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")).otherwise("")


def _with_check_digit(digits: Column) -> Column:
    """The last digit such that the Luhn sum is right."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))


def _with_iban_check(country: Column, rest: Column) -> Column:
    """An IBAN whose two check digits are right: what it spells in digits is 1 modulo 97."""
    spelt = F.concat(rest, country, F.lit("00"))

    def add(left: Column, i: Column) -> Column:
        c = F.substring(spelt, i, F.lit(1))
        return F.when(c.rlike(r"\d"), (left * 10 + F.ascii(c) - 48) % 97).otherwise((left * 100 + F.ascii(c) - 55) % 97)

    check = 98 - F.aggregate(F.sequence(F.lit(1), F.length(spelt)), F.lit(0), add)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _appended(values: list[str], stream: Column, times: Column, at: int) -> Column:
    """As many of ``values`` as ``times``, one after the other."""
    one = lambda i: F.when(i > 0, F.element_at(F.array(*map(F.lit, values)), _draw(stream, i + at) % len(values) + 1)).otherwise("")
    return F.array_join(F.transform(F.sequence(F.lit(0), times), one), "")


def streams(kind: Column, entity: Column, attempt: Column, key: str) -> dict[str, Column]:
    """The keyed digits of an entity and, for an e-mail, of its domain."""
    domain = F.concat_ws("\x1f", F.lit("domain"), F.substring_index(entity, "@", -1))
    return {"s": _stream(F.concat_ws("\x1f", kind, entity), attempt, key), "s_domain": _stream(domain, F.lit(0), key)}


def surrogate(kind: Column, entity: Column, attempt: Column, s: Column, of_domain: Column) -> Column:
    """The canonical surrogate drawn for an entity at an attempt; later attempts draw longer names and mailboxes."""
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    more = _appended([*ALPHABETS[1]], s, attempt, 90)
    email = F.concat(scramble(local, s), more, F.lit("@"), scramble(F.substring_index(domain, ".", 1), of_domain), F.lit(".example"))
    octets = F.concat_ws(".", *(F.concat((_draw(s, F.lit(k)) % (223 if k == 0 else 254) + 1).cast("string")) for k in range(4)))
    hex_of = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(F.repeat(s, 4), i, F.lit(1))).otherwise(c)
    six = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: hex_of(F.substring(entity, i, F.lit(1)), i)), "")
    hexes = F.when(entity.rlike("^[0-9A-F]{24,}$"), F.upper(F.substring(F.repeat(s, 64), F.lit(1), F.length(entity)))).when(entity.rlike("^[0-9a-f]{24,}$"), F.substring(F.repeat(s, 64), F.lit(1), F.length(entity)))
    mark = rf"^(?:{PREFIX}[_-]?)?"
    secret = F.coalesce(hexes, F.concat(F.regexp_extract(entity, mark, 0), scramble(F.regexp_replace(entity, mark, ""), s)))
    code = F.regexp_extract(entity, CODES, 0)
    number = F.substring(entity, F.length(code) + 1, F.length(entity))
    phone = F.when(F.startswith(entity, F.lit("0")), F.concat(F.lit("0"), scramble(F.substring(entity, F.lit(2), F.length(entity)), s))).otherwise(
        F.concat(code, (_draw(s, F.lit(100)) % 8 + 2).cast("string"), scramble(F.substring(number, F.lit(2), F.length(number)), s))
    )
    name = F
    for (what, script, gender), (begin, ends) in SYLLABLES.items():
        starts, lower = begin.split(), begin.lower().split()
        made = F.concat(_pick(starts, s, 1), F.when(attempt > 0, _pick(lower, s, 2)).otherwise(""), _appended(lower, s, F.greatest(attempt - 1, F.lit(0)), 30), _pick(ends.split(), s, 3))
        if (script, gender) in FIRST and what == "given":
            made = F.when(attempt == 0, _pick(FIRST[script, gender].split(), s, 4)).otherwise(made)
        of = (kind == what) if what == "given" else kind.isin("family", "name")
        name = name.when(of & F.startswith(entity, F.lit(f"{script} {gender}|")), F.lower(made))
    any_name = _pick("Ash Bel Cor Dun Hart Kel Lang Mar Nor Wes".lower().split(), s, 1)
    name = name.otherwise(F.concat(any_name, _appended(SYLLABLES["family", "latin", "u"][0].lower().split(), s, attempt + 1, 30), _pick("ley ton man well ford ham".split(), s, 3)))
    return (
        F.when(kind == "email", email).when(kind == "ip", F.when(F.contains(entity, F.lit(":")), six).otherwise(octets)).when(kind == "card", _with_check_digit(scramble(entity, s)))
        .when(kind == "secret", secret).when(kind == "phone", phone)
        .when(kind == "iban", _with_iban_check(F.substring(entity, F.lit(1), F.lit(2)), scramble(F.substring(entity, F.lit(5), F.length(entity)), s)))
        .when(kind.isin("given", "family", "name"), name).otherwise(scramble(entity, s))
    )


def written(kind: Column, m: Column, new: Column) -> Column:
    """A canonical surrogate in the format of the mention (or word of a name) ``m``."""

    def place(sign: str, signs: Column) -> Column:
        """``signs`` one by one for those of ``m`` that are ``sign``."""
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def step(acc: Column, i: Column) -> Column:
            c = F.substring(m, i, F.lit(1))
            takes = c.rlike(sign)
            return F.struct(F.concat(acc["out"], F.when(takes, F.substring(signs, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + F.when(takes, 1).otherwise(0)).alias("at"))

        return F.aggregate(F.sequence(F.lit(1), F.length(m)), start, step, lambda a: a["out"])

    letters = F.regexp_replace(m, r"[^\p{L}]", "")
    loud = (letters == F.upper(letters)) & (letters != F.lower(letters))
    count = F.length(_digits(m))
    return (
        F.when(kind.isin("phone", "card", "ssn"), place(r"\d", F.substring(new, F.length(new) - count + 1, count))).when(kind == "iban", place("[A-Z0-9]", new))
        .when(kind.isin("email", "ip") & loud, F.upper(new))
        .when(kind.isin("given", "family"), F.when(loud & (F.length(letters) > 1), F.upper(new)).otherwise(F.initcap(new)))
        .otherwise(new)
    )


def assign(entities: DataFrame, key: str | None = None, rounds: int = 60) -> DataFrame:
    """``kind, entity, surrogate`` for distinct (kind, entity): as written, all surrogates of a kind are distinct and none is an entity."""
    spark = entities.sparkSession
    key = key or session_key(spark)
    form = F.when(F.col("kind").isin("given", "family"), F.substring_index("entity", "|", -1)).otherwise(F.col("entity"))
    real, real_path = keep(entities.select("kind", "entity").distinct(), "entities")
    forms = real.select("kind", form.alias("surrogate"))
    todo = real.withColumn("attempt", F.lit(0))
    done, old, what = [], [real_path], (F.col("kind"), F.col("entity"), F.col("attempt"))
    for _ in range(rounds):
        drawn, drawn_path = keep(todo.withColumns(streams(*what, key)).withColumn("surrogate", surrogate(*what, F.col("s"), F.col("s_domain"))).drop("s", "s_domain"), "drawn")
        old.append(drawn_path)
        fresh = drawn.join(forms, ["kind", "surrogate"], "left_anti")
        for taken in done:
            fresh = fresh.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = fresh.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        won, _ = keep(won.select("kind", "entity", "surrogate"), "surrogates")
        done.append(won)
        todo, path = keep(drawn.join(won, ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "again")
        old.append(path)
        if not todo.take(1):
            break
    else:
        raise RuntimeError("surrogates still collide")
    discard(spark, *old)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _with_names(found: DataFrame) -> DataFrame:
    """``pattern`` and mentions ``m`` of texts in which someone is named: the same names alone are mentions too."""
    words = F.flatten(F.transform(F.filter("m", lambda x: kind_of(x) == "name"), _name_words))
    alone = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(f"^{_either(WORDS)}$")))
    named = once(found, "names", F.array_sort(alone, lambda a, b: F.length(b) - F.length(a)))
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(f"{PATTERN}|{BEGIN}(?:"), F.array_join("names", "|"), F.lit(f"){END}"))).otherwise(F.lit(PATTERN))
    with_pattern = named.withColumn("pattern", pattern).drop("names")
    return with_pattern.withColumn("m", F.when(F.col("pattern") == PATTERN, F.col("m")).otherwise(F.regexp_extract_all("t", F.col("pattern"), F.lit(0))))


def mentions_of(found: DataFrame) -> DataFrame:
    """``h, m, kind, at, word, entity``: a row for each word of a name, one for any other mention, once a text."""
    people = F.transform(F.filter("m", lambda x: kind_of(x) == "name"), lambda x: F.struct(_name_words(x).alias("words"), _title_gender(x).alias("gender")))
    each = once(found.select("h", "m"), "people", people)
    each = each.select("h", "people", F.explode(F.array_distinct("m")).alias("m")).distinct()
    each = each.withColumn("kind", kind_of(F.col("m")))
    words, only = _name_words(F.col("m")), F.get(_name_words(F.col("m")), 0)
    families = F.transform(F.filter("people", lambda p: F.size(p["words"]) > 1), lambda p: F.element_at(p["words"], -1))
    titled = lambda w: F.get(F.filter("people", lambda p: p["gender"].isNotNull() & (F.size(p["words"]) > 1) & (F.get(p["words"], 0) == w)), 0)["gender"]
    givens = F.transform(F.filter("people", lambda p: F.size(p["words"]) > 1), lambda p: F.get(p["words"], 0))
    is_given = (F.size(words) == 1) & F.array_contains(givens, only) & ~F.array_contains(families, only)
    role = lambda k: F.when((k < F.size(words) - 1) | is_given, "given").otherwise("family")
    part = lambda w, k: F.struct(
        k.alias("at"), w.alias("word"), F.when(F.endswith(w, F.lit(".")), "initial").otherwise(role(k)).alias("kind"),
        F.when(role(k) == "given", given_entity(w, F.coalesce(_title_gender(F.col("m")), titled(w)))).otherwise(family_entity(w)).alias("entity"),
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("m").alias("word"), F.col("kind"), canonical(F.col("kind"), F.col("m")).alias("entity")))
    parts = F.when(F.col("kind") == "name", F.transform(words, part)).otherwise(whole)
    return each.select("h", "m", F.explode(parts).alias("p")).select("h", "m", "p.*")


def replace_entities(docs: DataFrame, key: str | None = None, text: str = "text", kinds: str | None = None) -> DataFrame:
    """``docs`` with surrogates in place of the entities of ``text``; ``kinds`` names a column for what was found."""
    columns, quoted = docs.columns, F.col(f"`{text}`")
    record = F.struct(*(F.col(f"`{c}`") for c in columns))
    every = F.coalesce(F.regexp_extract_all(quoted, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    scanned, _ = keep(docs.select(record.alias("r"), every.alias("m")), "scanned")  # the one scan
    of = lambda t: [t if c == text else F.col("r").getField(c).alias(c) for c in columns]
    without = scanned.where("size(m) = 0").select(*of(F.col("r").getField(text).alias(text)), *([F.lit("").alias(kinds)] if kinds else []))
    found = scanned.where("size(m) > 0").withColumn("t", F.col("r").getField(text)).withColumn("h", F.sha2("t", 256))
    found, _ = keep(_with_names(found), "found")
    parts, parts_path = keep(mentions_of(found), "mentions")
    given = join_hot(parts.where("kind <> 'initial'"), assign(parts.where("kind <> 'initial'"), key), ["kind", "entity"])
    new = given.select("h", "m", "at", "kind", written(F.col("kind"), F.col("word"), F.col("surrogate")).alias("new")).unionByName(
        parts.where("kind = 'initial'").select("h", "m", "at", "kind", F.col("word").alias("new"))
    )
    is_name = F.max(F.col("kind").isin("given", "family"))
    mentions = new.groupBy("h", "m").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new"),
        F.when(is_name, "name").otherwise(F.max("kind")).alias("kind"),
    )
    mentions = mentions.withColumn("new", F.when(F.col("kind") == "name", F.concat(_title(F.col("m")), "new")).otherwise(F.col("new")))
    maps = mentions.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("to"), F.array_join(F.array_sort(F.collect_set("kind")), " ").alias("k"))
    maps, _ = keep(maps, "maps")
    discard(docs.sparkSession, parts_path)
    between = F.split("t", F.col("pattern"), -1)
    joined = F.array_join(F.zip_with(between, "m", lambda a, b: F.concat(a, F.coalesce(F.element_at("to", b), b, F.lit("")))), "")
    with_them = join_hot(found, maps, ["h"], "left").withColumn("t", F.when(F.col("to").isNull(), F.col("t")).otherwise(joined))
    return without.unionByName(with_them.select(*of(F.col("t").alias(text)), *([F.coalesce("k", F.lit("")).alias(kinds)] if kinds else [])))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(bind_text(table(spark, sf_dir, "documents"), "doc_id", "text"), kinds="kinds")
