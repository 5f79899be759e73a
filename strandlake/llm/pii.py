r"""Operator 4: surrogates for personal data, with DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, IBANs, US social security numbers, phone numbers, card numbers (13 to 19 digits),
hexadecimal secrets (32 to 64 digits) and names after a title.  An entity has parts (kind, canonical form): a name's given
name and surname are parts of their own, everything else is one part; spelling, spaces and case do not count, so mentions of
one entity are one part everywhere (coreference).

The distinct parts of the corpus form a table.  Each gets a replacement from a keyed SHA-512 stream: digits for digits,
letters for letters, valid check digits for valid card numbers and IBANs, an IBAN's country as it is, given names of the gender
the title states, surnames in the script of the original (Latin, Cyrillic or Greek; others become Latin).  Collision checks: of parts with one replacement all but the first, and parts whose replacement
is a real entity of the corpus, draw again, up to ``DRAWS`` times; names grow by a syllable with each draw.  Where a shape
(digits and letters of one length) is so full of real entities that some parts still collide, all parts of that shape take one
another's place in a keyed order instead.  Either way distinct parts have distinct replacements, none its own.  Replacements
then go back into each mention in its own format: separators, country code, title and case stay.

The entity patterns run once over each text that has a hint of one; each distinct text with an entity is cut into gaps and
mentions, written, and rewritten from there.  Only documents with such a text are joined; a part that a third of all documents
mention is joined by key after its mentions are made distinct per text.  Defined cases: null text stays null; texts without entities stay as they are; repeated rows get equal texts; a null doc_id
is a document like others; an empty table gives an empty table; an input column n_entities is replaced, other
columns stay as they came, whatever their names; very long texts are cut and rewritten whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marked, marks, materialize, scratch, without

# Titles that state a gender, and given names of either gender by script.
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
GIVEN = {
    ("m", "latin"): ("Adrian", "Bruno", "Conrad", "Dennis", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Julian", "Kilian", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    ("f", "latin"): ("Alma", "Bianca", "Carla", "Diana", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Maria", "Nora", "Olivia", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Юлия"),
    ("m", "greek"): ("Αντώνης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Ιάκωβος", "Κώστας", "Λουκάς", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης", "Χρήστος"),
    ("f", "greek"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θεοδώρα", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Ουρανία", "Σοφία", "Χρύσα"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "lu", "ka", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu", "ha"),
    "cyrillic": ("ба", "де", "фи", "го", "лу", "ка", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "зу", "ха"),
    "greek": ("βα", "δε", "φι", "γο", "λου", "κα", "με", "νι", "πο", "ρου", "σα", "τε", "βι", "το", "ζου", "χα"),
}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9À-ɏ._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9-]\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|(?<=[ .-])\d{2,4}|(?<![\w.-])\d{3}(?=[ .-]))[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d|[ .-]\d{4})",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text without any entity lacks: an @, two digits side by side or with one separator between, 32 hexadecimal digits or a title.
HINT = rf"@|\d[ .-]?\d|[0-9A-Fa-f]{{32}}|(?:{_TITLES})\.? \p{{Lu}}"
_PART = "array<struct<kind:string,canon:string>>"
#: Draws of a replacement before a shape counts as full; parts of one shape that take one another's place together.
DRAWS, TOGETHER = 12, 100_000
#: Stands around mentions while a text is cut; texts that hold it themselves are cut in two passes.
_MARK = "\uffff"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _kind(e: Column) -> Column:
    """The kind of a mention that stands alone: what a pattern wants before it may also be the start of the string."""
    out = F.lit("other")
    for k, p in reversed(PATTERNS.items()):
        alone = p.replace("(?<=[ .-])", "(?<![^ .-])")
        out = F.when(F.regexp_like(e, F.lit(rf"^(?:{alone})$")), F.lit(k)).otherwise(out)
    return out


def _script(c: Column) -> Column:
    out = F.lit("latin")
    for s in ("cyrillic", "greek"):
        out = F.when(F.regexp_like(c, F.lit(rf"\p{{Is{s.capitalize()}}}")), F.lit(s)).otherwise(out)
    return out


def _parts(e: Column, kind: Column) -> Column:
    """The parts of a mention, in the order in which they stand."""
    def name(i: int) -> Column:
        return F.regexp_extract(e, rf"^(?:{_TITLES})\.? ({_NAME})(?: ({_NAME}))?$", i)

    gender = F.when(F.regexp_like(e, F.lit(rf"^(?:{'|'.join(MALE_TITLES)})\.? ")), F.lit("m")).otherwise(F.lit("f"))
    one, two = name(1), name(2)
    given = F.struct(F.concat(F.lit("given_"), gender, F.lit("_"), _script(one)).alias("kind"), F.lower(one).alias("canon"))
    last = F.when(two == "", one).otherwise(two)
    family = F.struct(F.concat(F.lit("surname_"), _script(last)).alias("kind"), F.lower(last).alias("canon"))
    canon = F.when(kind == "phone", F.right(_digits(e), F.lit(10))).when(kind.isin("card", "ssn"), _digits(e)).otherwise(F.lower(F.replace(e, F.lit(" "), F.lit(""))))
    plain = F.array(F.struct(kind.alias("kind"), canon.alias("canon")))
    return F.when(kind != "person", plain).when(two == "", F.array(family)).otherwise(F.array(given, family)).cast(_PART)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(canon: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters (a to f stay among themselves in hexadecimal strings)."""
    letters = F.when(F.regexp_like(canon, F.lit("^[0-9a-f]{32,}$")), F.lit(6)).otherwise(F.lit(26))

    def one(c: Column, i: Column) -> Column:
        v = _byte(digest, i)
        return F.when(F.regexp_like(c, F.lit("[0-9]")), (v % 10).cast("string")).when(F.regexp_like(c, F.lit("[a-z]")), F.char(97 + v % letters)).otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """The number modulo 97 that digits and lower-case letters (10 to 35) are together."""
    def add(a: Column, x: Column) -> Column:
        return F.when(F.regexp_like(x, F.lit("[0-9]")), (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 87) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban_valid(canon: Column) -> Column:
    return _mod97(F.concat(F.substring(canon, F.lit(5), F.char_length(canon)), F.left(canon, F.lit(4)))) == 1


def _draw(key: str) -> Column:
    """The replacement of (kind, canon) at its number of draws."""
    kind, canon, n = F.col("kind"), F.col("canon"), F.col("draw")
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, n.cast("string")), 512)
    like = _like(canon, digest)
    head = F.substring(like, F.lit(1), F.char_length(canon) - 1)
    card = F.when(_luhn(canon) == 0, F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string"))).otherwise(like)
    octets = F.array_join(F.array(*[(1 + _byte(digest, F.lit(i)) % 254).cast("string") for i in range(4)]), ".")
    local = _like(F.substring_index(canon, "@", 1), digest)
    mail = F.concat(F.regexp_replace(local, r"[^a-z0-9._%+-]", "x"), F.substring(digest, 120, 4), F.lit("@mail.example.net"))
    land, body = F.left(canon, F.lit(2)), F.substring(like, F.lit(5), F.char_length(canon))
    check = F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(_iban_valid(canon), check).otherwise(F.substring(like, 3, 2)), body)
    out = F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", octets).when(kind == "email", mail)
    for (g, s), names in GIVEN.items():
        pick = F.element_at(F.array(*map(F.lit, names)), 1 + _byte(digest, F.lit(0)) % len(names))
        more = _syllables(digest, _array(s), n)
        out = out.when(kind == f"given_{g}_{s}", F.lower(F.concat(pick, F.when(n > 0, more).otherwise(F.lit("")))))
    for s in SYLLABLES:
        out = out.when(kind == f"surname_{s}", _syllables(digest, _array(s), n + 4))
    return out.otherwise(like)


def _array(script: str) -> Column:
    return F.array(*map(F.lit, SYLLABLES[script]))


def _syllables(digest: Column, names: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(names, 1 + _byte(digest, i) % 16)), "")


def _shape(kind: Column, canon: Column) -> Column:
    """What a replacement keeps: kind, length, places of digits and letters, an IBAN's country, and whether check digits are valid."""
    plain = F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), r"\p{L}", "a")
    valid = F.when(kind == "card", _luhn(canon) == 0).when(kind == "iban", _iban_valid(canon))
    return F.concat_ws("|", kind, plain, valid.cast("string"), F.when(kind == "iban", F.left(canon, F.lit(2))))


def _permuted(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new): within each shape every part takes the place of the next one in a keyed order, the last of the first."""
    rows = parts.select("kind", "canon", _shape(F.col("kind"), F.col("canon")).alias("shape"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon"), 256))
    many = rows.groupBy("shape").agg((F.floor(F.count("*") / TOGETHER) + 1).alias("many"))
    rows = rows.join(many, "shape").withColumn("block", F.pmod(F.xxhash64("h"), "many"))
    ring = Window.partitionBy("shape", "block")
    new = F.coalesce(F.lead("canon").over(ring.orderBy("h")), F.first("canon").over(ring.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("kind", "canon", new.alias("new"))


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new): distinct replacements of distinct parts, none of them a part itself unless its shape is full."""
    with scratch(parts.sparkSession):
        real = parts.select("kind", "canon")
        table = materialize(real.withColumn("draw", F.lit(0)).withColumn("new", _draw(key)), "surrogates")
        for draw in range(DRAWS + 1):
            first = table.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
            taken = first.join(real.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real")), ["kind", "new"], "left")
            bad = materialize(taken.where("n > 1 OR real").select("kind", "new", "first", F.coalesce("real", F.lit(False)).alias("real")), "collisions")
            if draw == DRAWS or bad.isEmpty():
                break
            again = F.coalesce(F.col("real") | (F.col("canon") != F.col("first")), F.lit(False))
            table = table.join(bad, ["kind", "new"], "left").withColumn("draw", F.col("draw") + again.cast("int"))
            table = materialize(table.withColumn("new", F.when(again, _draw(key)).otherwise(F.col("new"))).select("kind", "canon", "draw", "new"), "surrogates")
        if not bad.isEmpty():
            shape = _shape(F.col("kind"), F.col("canon"))
            full = table.join(bad.select("kind", "new"), ["kind", "new"], "left_semi").select(shape.alias("shape")).distinct()
            full = materialize(full, "full")
            marked_ = table.withColumn("shape", shape)
            table = marked_.join(full, "shape", "left_anti").select("kind", "canon", "new").union(_permuted(marked_.join(full, "shape", "left_semi"), key))
        return materialize(table.select("kind", "canon", "new"), "replacements", keep=True)


def _render(surface: Column, kind: Column, new: Column) -> Column:
    """The mention with its replacement(s), ``new`` in the order of its parts, in the format of the original."""
    one = F.element_at(new, 1)
    digits = _digits(surface)
    filler = F.when(kind == "phone", F.concat(F.left(digits, F.greatest(F.char_length(digits) - 10, F.lit(0))), one)).otherwise(one)

    def char(c: Column, i: Column) -> Column:
        at = F.char_length(F.regexp_replace(F.substring(surface, F.lit(1), i), "[^0-9A-Za-z]", "")) + 1
        x = F.substring(filler, at, F.lit(1))
        return F.when(F.regexp_like(c, F.lit("[A-Z]")), F.upper(x)).when(F.regexp_like(c, F.lit("[0-9a-z]")), x).otherwise(c)

    filled = F.array_join(F.transform(F.split(surface, ""), char), "")
    mail = F.when(F.upper(surface) == surface, F.upper(one)).otherwise(one)
    title = F.regexp_extract(surface, rf"^((?:{_TITLES})\.? )", 1)
    shout = F.regexp_like(surface, F.lit(r" \p{Lu}{2,}"))
    person = F.concat(title, F.array_join(F.transform(new, lambda x: F.when(shout, F.upper(x)).otherwise(F.initcap(x))), " "))
    return F.when(kind == "person", person).when(kind == "email", mail).when(kind == "ip", one).otherwise(filled)


def _cut(text: Column) -> Column:
    """A text as gap, mention, gap, ..., gap."""
    found, gaps = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.split(text, F.lit(ENTITY), F.lit(-1))
    both = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.array(g, F.get(found, i))).otherwise(F.array(g))))
    once = F.split(F.regexp_replace(text, F.lit(f"({ENTITY})"), F.lit(f"{_MARK}$1{_MARK}")), F.lit(_MARK), F.lit(-1))
    return F.when(F.contains(text, F.lit(_MARK)), both).otherwise(once)


def replace_private(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` with replaced texts and n_entities (mentions)."""
    mine = ["__h", "__g"]
    ids = {"__h": F.xxhash64("text"), "__g": F.crc32(F.coalesce(F.col("text"), F.lit("")))}
    with scratch(docs.sparkSession):
        hint = F.coalesce(F.regexp_like("text", F.lit(HINT)), F.lit(False))
        cut = docs.select("text").where(hint).withColumns(ids).withColumn("cut", _cut(F.col("text")))
        cut = materialize(cut.where(F.size("cut") > 1).select(*mine, "cut").dropDuplicates(mine), "cut")
        mention = F.filter("cut", lambda x, i: i % 2 == 1)
        mentions = cut.select(*mine, F.explode(F.array_distinct(mention)).alias("surface"))
        surfaces = mentions.select("surface").distinct().withColumn("kind", _kind(F.col("surface")))
        surfaces = materialize(surfaces.withColumn("parts", _parts(F.col("surface"), F.col("kind"))), "surfaces")
        exploded = surfaces.select("surface", F.col("kind").alias("whole"), F.posexplode("parts").alias("i", "p")).select("*", "p.*")
        table = surrogates(materialize(exploded.select("kind", "canon").distinct(), "parts"), key)
        # mentions of one surface are one row here, however many documents hold it
        named = exploded.join(table, ["kind", "canon"]).groupBy("surface", "whole").agg(F.array_sort(F.collect_list(F.struct("i", "new"))).alias("new"))
        named = materialize(named.select("surface", _render(F.col("surface"), F.col("whole"), F.transform("new", lambda x: x["new"])).alias("new")), "named")
        maps = mentions.join(named, "surface").groupBy(*mine).agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("map"))
        text = F.array_join(F.transform("cut", lambda x, i: F.when(i % 2 == 1, F.element_at("map", x)).otherwise(x)), "")
        new = cut.join(maps, mine).select(*mine, text.alias("__new"), F.size(mention).cast("long").alias("__n"))
        new = materialize(new, "rewritten", keep=True)
        table = materialize(marks(new, mine), "marks", keep=True)
    names = without(docs, "n_entities").columns
    every = marked(docs.withColumns(ids), mine, table, "__some")
    some = every.where("__some").join(new, mine, "left")
    cols = [F.coalesce("__new", "text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names]
    rest = every.where("NOT __some").select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_entities"))
    return some.select(*cols, F.coalesce("__n", F.lit(0).cast("long")).alias("n_entities")).unionAll(rest)
