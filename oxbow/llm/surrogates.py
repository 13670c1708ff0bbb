"""Personal data replaced by keyed surrogates of the same type and form.
DataFrame functions only.

Every mention is reduced to a canonical entity (letters and digits, lower case), so
that spellings of one entity corefer.  An entity's surrogate comes from an HMAC and
keeps type, length, script, letter case, separators, check digits of cards and account
numbers and, for titled names, the title's gender.  Surrogates that meet each other or a
real entity are drawn again until all are distinct; each few draws a form grows by a
character, so no form runs out.  The key's pads stand in a one-row table, not in the plan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.llm.common import sift, stage

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# Courtesy titles and the gender they tell (f, m, or x for either).
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Госпожа": "f",
    "Dr": "x", "Prof": "x",
}
_TITLE = r"(?<![\p{L}])(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?"

#: Types in order of precedence.  The patterns are tried at each place in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "name": rf"{_TITLE} \p{{Lu}}[\p{{Ll}}'-]+(?: \p{{Lu}}[\p{{Ll}}'-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every pattern needs one of these: an @, a digit, a title, or 32 hex letters.
HINT = r"[0-9@]|[A-Fa-f]{32}|" + _TITLE
#: Draws after which a form grows by one character more.
PATIENCE = 4

# Alphabets by script, and given names by script and gender.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "armenian": "".join(map(chr, range(0x561, 0x587)))}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("greek", "m"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Ιάσων", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης"],
    ("greek", "f"): ["Αγγελική", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Ολυμπία", "Ρένα", "Σοφία"],
    ("armenian", "m"): ["Արամ", "Արմեն", "Գագիկ", "Դավիթ", "Կարեն", "Հայկ", "Նարեկ", "Տիգրան"],
    ("armenian", "f"): ["Աննա", "Անի", "Գայանե", "Լիլիթ", "Կարինե", "Մարիամ", "Նարե", "Շուշան"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"],
    ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Ева", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Рита", "Софья", "Юлия"],
}
#: Characters that tell a script, by which letters are swapped; letters of others count as Latin.
BLOCKS = {"greek": r"[Ͱ-Ͽἀ-῿]", "cyrillic": r"[Ѐ-ӿ]", "armenian": r"[԰-֏]", "latin": r"\p{L}"}
SYLLABLES = {
    "latin": ["bar", "ben", "cal", "der", "fal", "gor", "hal", "ker", "lan", "mar", "nor", "per", "ros", "sel", "tor", "wil"],
    "greek": ["βαρ", "γαλ", "δαν", "θεο", "καλ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαν", "τασ", "φιλ", "χαρ", "ψαλ", "ζαν"],
    "armenian": ["բար", "գոր", "դան", "զար", "կար", "հար", "մար", "նար", "պետ", "սար", "վար", "տեր"],
    "cyrillic": ["бар", "вел", "гор", "дан", "жар", "зел", "кар", "лан", "мар", "нор", "пол", "рос", "сел", "тор", "хал", "чер"],
}


def _canonical(kind: Column, mention: Column) -> Column:
    plain = F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    named = F.lower(F.regexp_replace(mention, r"^\S+ ", ""))  # the title is no part of a name
    return F.when(kind.isin("ip", "email"), F.lower(mention)).when(kind == "name", named).otherwise(plain)


def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _table(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of the HMAC under ``key``."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def _stream(message: Column) -> Column:
    """256 hex digits: HMAC-SHA-256 of the message under four counters; inner and outer are columns."""

    def mac(k: int) -> Column:
        inside = F.sha2(F.concat(F.col("inner"), F.concat(message, F.lit(f"|{k}")).cast("binary")), 256)
        return F.sha2(F.concat(F.col("outer"), F.unhex(inside)), 256)

    return F.concat(*[mac(k) for k in range(4)])


def _byte(stream: Column, at: Column) -> Column:
    """Byte ``at`` of a hex stream as a number, wrapping at its end."""
    return F.conv(F.substring(stream, F.pmod(at * 2, F.lit(256)) + 1, F.lit(2)), 16, 10).cast("int")


def _swapped(text: Column, stream: Column, free: Column) -> Column:
    """``text`` with each letter and digit from place ``free`` on replaced within its alphabet."""

    def one(i: Column) -> Column:
        ch, draw = F.substring(text, i + 1, F.lit(1)), _byte(stream, i)
        out = F.when(ch.rlike(r"\d"), F.pmod(draw, F.lit(10)).cast("string"))
        for script, block in BLOCKS.items():
            letters = ALPHABETS[script]
            out = out.when(ch.rlike(block), F.substring(F.lit(letters), F.pmod(draw, F.lit(len(letters))) + 1, F.lit(1)))
        return F.when(i < free, ch).otherwise(out.otherwise(ch))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")


def _bound(value: Column, f) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _grown(text: Column, stream: Column, more: int, letters: str, front: bool = False) -> Column:
    """``text`` with ``more`` characters of ``letters`` added."""
    if not more:
        return text
    tail = F.array_join(F.transform(F.sequence(F.lit(100), F.lit(99 + more)), lambda i: F.substring(F.lit(letters), F.pmod(_byte(stream, i), F.lit(len(letters))) + 1, F.lit(1))), "")
    return F.concat(tail, text) if front else F.concat(text, tail)


def _luhn(digits: Column) -> Column:
    """``digits`` with the last one replaced by the check digit of the others."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return total + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), add)
    return F.concat(F.substring(digits, F.lit(1), n - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _checked_account(account: Column) -> Column:
    """``account`` with places 3 and 4 set so that its number is 1 modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(2)), F.lit("00"))

    def remainder(x: Column) -> Column:
        def step(rest: Column, i: Column) -> Column:
            ch = F.ascii(F.substring(x, i, F.lit(1)))
            return F.when(ch < 58, rest * 10 + ch - 48).otherwise(rest * 100 + ch - 87) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), step)

    check = 98 - _bound(turned, remainder)
    return F.concat(F.substring(account, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account)))


def _surrogate(kind: Column, entity: Column, gender: Column, draw: int) -> Column:
    stream = _stream(F.concat_ws("|", kind, entity, F.lit(str(draw))))
    return _bound(stream, lambda x: _from_stream(kind, entity, gender, x, draw))


def _from_stream(kind: Column, entity: Column, gender: Column, stream: Column, draw: int) -> Column:
    more, digits, letters = draw // PATIENCE, "0123456789", ALPHABETS["latin"]
    octets = [_byte(stream, F.lit(k)).cast("string") for k in range(1, 4 + max(0, draw // PATIENCE - 4))]
    first = F.pmod(_byte(stream, F.lit(0)), F.lit(15)) + 240 if draw < PATIENCE else F.pmod(_byte(stream, F.lit(0)), F.lit(223)) + 1
    at = F.length(F.substring_index(entity, ".", -1))
    mail = F.concat(_swapped(F.substring(entity, F.lit(1), F.length(entity) - at), stream, F.lit(0)), F.right(entity, at))
    sex = F.when(gender == "x", F.when(F.pmod(_byte(stream, F.lit(9)), F.lit(2)) == 0, "f").otherwise("m")).otherwise(gender)
    script = F.lit("latin")
    for s in ("armenian", "cyrillic", "greek"):
        script = F.when(entity.rlike(BLOCKS[s]), s).otherwise(script)
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        given = F.when((script == s) & (sex == g), F.element_at(_table(names), F.pmod(_byte(stream, F.lit(0)), F.lit(len(names))) + 1)).otherwise(given)
    for s, parts in SYLLABLES.items():
        built = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3 + more)), lambda i: F.element_at(_table(parts), F.pmod(_byte(stream, i), F.lit(len(parts))) + 1)), "")  # noqa: B023
        family = F.when(script == s, built).otherwise(family)
    name = F.when(F.instr(entity, " ") > 0, F.concat_ws(" ", F.lower(given), family)).otherwise(family)
    return (
        F.when(kind == "ip", F.concat_ws(".", first.cast("string"), *octets))
        .when(kind == "secret", F.substring(stream, F.lit(1), F.length(entity) + more))
        .when(kind == "email", _grown(mail, stream, more, letters, front=True))
        .when(kind == "name", name)
        .when(kind == "iban", _bound(_grown(_swapped(entity, stream, F.lit(2)), stream, more, digits), _checked_account))
        .when(kind == "card", _bound(_grown(_swapped(entity, stream, F.lit(2)), stream, more, digits), _luhn))
        .otherwise(_grown(_swapped(entity, stream, F.lit(0)), stream, more, digits))
    )


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's form: its separators and letter case."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.length(mention)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda acc, i: F.when(
            F.substring(mention, i, F.lit(1)).rlike(r"[\p{L}\p{N}]"),
            F.struct(
                F.concat(acc["out"], F.when(F.substring(mention, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(surrogate, acc["k"], F.lit(1)))).otherwise(F.substring(surrogate, acc["k"], F.lit(1)))).alias("out"),
                (acc["k"] + 1).alias("k"),
            ),
        ).otherwise(F.struct(F.concat(acc["out"], F.substring(mention, i, F.lit(1))).alias("out"), acc["k"].alias("k"))),
        lambda acc: F.concat(acc["out"], F.substring(surrogate, acc["k"], F.length(surrogate))),
    )
    whole = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind == "ip", surrogate)
        .when(kind == "email", whole)
        .when(kind == "name", F.concat(F.regexp_extract(mention, r"^(\S+ )", 1), F.initcap(surrogate)))
        .otherwise(step)
    )


def _gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, r"^(\p{L}+)", 1)
    out = F.lit("x")
    for g in "fm":
        out = F.when(title.isin([t for t, x in TITLES.items() if x == g]), g).otherwise(out)
    return out


def surrogate_table(mentions: DataFrame, key: str) -> DataFrame:
    """mention, kind, entity, surrogate, replacement for each distinct ``mention``.

    Rounds of draws: an entity keeps its surrogate if no other entity of its type
    holds or draws it and it is no real entity; the others draw again.  Forms grow with
    the draws, so the rounds end.
    """
    spark = mentions.sparkSession
    pads = spark.createDataFrame([(0, *map(bytearray, _pads(key)))], "one int, inner binary, outer binary")
    known = stage(
        mentions.select("mention").distinct().withColumn("kind", _kind(F.col("mention")))
        .withColumn("entity", _canonical(F.col("kind"), F.col("mention"))).withColumn("gender", _gender(F.col("mention"))),
        "mentions",
    )
    real = known.select("kind", F.col("entity").alias("surrogate")).distinct()
    entities = known.groupBy("kind", "entity").agg(F.min("gender").alias("gender"))
    settled, open_, draw = None, entities, 0
    while True:
        keyed = open_.withColumn("one", F.length("entity") * 0).join(F.broadcast(pads), "one")  # one row
        drawn = stage(keyed.select("kind", "entity", "gender", _surrogate(F.col("kind"), F.col("entity"), F.col("gender"), draw).alias("surrogate")), "draws")
        fresh = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            fresh = fresh.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = fresh.groupBy("kind", "surrogate").agg(F.min_by("entity", F.xxhash64("entity")).alias("entity"))
        settled = stage(first if settled is None else settled.unionByName(first), "settled")
        open_ = drawn.join(settled, ["kind", "entity"], "left_anti").select("kind", "entity", "gender")
        if open_.isEmpty():
            break
        draw += 1
    out = known.join(settled, ["kind", "entity"]).select("mention", "kind", "entity", "surrogate", _rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("replacement"))
    return stage(out, "surrogates")


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity replaced, plus n_entities (mentions replaced).

    Null texts stay null; empty texts and texts without entities stay as they are.  Equal
    texts and repeated rows get equal replacements, and one entity has one surrogate in the
    whole table; of entities that draw the same, the one of least hash keeps it.  A very
    long text is searched whole by one task.  An empty table gives an empty table.  Other
    columns pass through under any name.
    """
    text = docs[text_col]
    found = docs.where(text.rlike(HINT)).select(F.xxhash64(text).alias("text_key"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))).alias("mention"))
    held = stage(found.distinct(), "found")
    table = surrogate_table(held.select("mention"), key)
    by_text = stage(
        held.join(table.select("mention", "replacement"), "mention")
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("swap")),
        "swaps",
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    perhaps, others = sift(rows, by_text, "text_key")
    out = perhaps.join(by_text, "text_key", "left").withColumn("said", F.when(F.col("swap").isNotNull(), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    between = F.split("text", PATTERN, -1)
    new = F.array_join(
        F.flatten(F.zip_with(between, "said", lambda a, m: F.array(a, F.coalesce(F.element_at(F.col("swap"), m), F.lit(""))))), ""
    )

    def shown(text: Column, n: Column) -> list[Column]:
        return [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns] + [n.cast("long").alias("n_entities")]

    replaced = out.select(*shown(F.when(F.col("said").isNotNull(), new).otherwise(F.col("text")), F.coalesce(F.size("said"), F.lit(0))))
    return replaced.union(others.select(*shown(F.col("text"), F.lit(0))))
