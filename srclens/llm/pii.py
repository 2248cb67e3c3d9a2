"""Surrogates for personal data: keyed, type-consistent, distinct.

Detected are e-mail addresses, IPv4 addresses, telephone, payment card, social
security and IBAN numbers, credentials behind words such as ``password=``, and
names behind a form of address (Mr, Frau, Señora ..., also in capitals). A name
without one is not found. Each mention is cut into parts, and each distinct part
of the corpus is one entity with one surrogate, drawn from SHA-256 of a secret
key, its type and its normal form (case of names and addresses, punctuation of
numbers and spacing do not matter):

* a name is taken word by word, however many there are, so ``Mr. John A. Smith``
  and ``MR. SMITH`` share their family name. A word is a family name if it comes
  last at least as often as before another one in the corpus, else a given name;
  given names become given names of the gender that the form of address tells
  (else of the gender most of the word's mentions tell, else of either) and of
  the same script, family names are put together from syllables. Initials are
  moved along the alphabet by a keyed step; particles (von, de) and 's stay;
* an e-mail address is a local part and a host, so colleagues stay colleagues;
  its top-level domain and the case of each letter stay;
* a telephone number keeps its country code (E.164) and leading zeros, so that a
  number with and without the code stays one;
* a card keeps its first digit and, where the original had one, a valid check
  digit; octets stay octets; all numbers keep their punctuation;
* letters become letters of the same case and script (Latin, Cyrillic, Greek).

The table of distinct entities is checked for collisions: of entities with
the same surrogate, and of a surrogate that is itself an entity of the
corpus, all but the first are drawn again until none is left. Every second
draw makes the surrogate one sign (names: one syllable) longer, so that this
ends also where the values of a format are all taken; only there does a
surrogate differ in length. Only documents that hold an entity are joined with
the table. All steps are SQL functions.

Null and empty texts stay as they are. Repeated rows each give a row; ties are
decided by hash, then value. An empty table gives an empty one. Other columns are
kept, whatever their names, but for an ``n_entities`` of the input, which the
operator's own replaces; ``n_chars``, if there is one, is counted anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

KEY = "surrogates-1"

# Forms of address, particles of names, words before credentials, E.164 country codes.
TITLES = {"m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "господин"],
          "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "госпожа"],
          "n": ["Dr", "Prof", "Professor", "Doctor"]}
PARTICLES = "van von der den de del della di da dos du la le el bin ibn al zu zur ter ten y".split()
CREDENTIAL = "(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)"
COUNTRY = "\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
GAP = "[ \\u00a0]"


def _any_case(titles: list[str]) -> str:
    """Alternatives as written, in capitals and, but for single letters, in small letters."""
    return "(?:" + "|".join(dict.fromkeys(x for t in titles for x in (t, t.upper(), t.lower()) if len(t) > 1 or x == t)) + ")"


TITLE = _any_case([t for g in TITLES.values() for t in g])
CREDENTIAL_BEFORE = f"{CREDENTIAL}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']{{0,1}}"
TITLE_BEFORE = "\\.{0,1}[ \\u00a0\\n]{1,2}"
INITIAL = "\\p{Lu}(?![\\p{L}\\p{M}'’])\\.?"
NAME_WORD = "\\p{Lu}[\\p{L}\\p{M}'’]+(?:-[\\p{L}\\p{M}'’]+)*+"
PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
#: type -> pattern, in order of precedence; the short looks behind come first, so that long ones are rarely tried.
PATTERNS = {
    "secret": f"(?<=[=: \"'])(?<={CREDENTIAL_BEFORE})[A-Za-z0-9_+/.~-]{{6,}}",
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\\.[A-Za-z]{2,}",
    "iban": "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b",
    "ip": f"(?<![0-9.]){OCTET}(?:\\.{OCTET}){{3}}(?![0-9]|\\.[0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9-])|(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "phone": "(?<![0-9+])\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
             "|\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "name": f"(?=[\\p{{Lu}}a-z])(?<=[ \\u00a0\\n])(?<=\\b{TITLE}{TITLE_BEFORE})(?:{PARTICLE}{GAP}){{0,3}}(?:{NAME_WORD}|{INITIAL})"
            f"(?:{GAP}(?:{PARTICLE}{GAP}){{0,3}}(?:{NAME_WORD}|{INITIAL}))*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold before the patterns are worth trying.
HINT = f"[0-9@]|\\b{TITLE}\\b|{CREDENTIAL}"

#: Given names by gender and script: fixed values.
GIVEN = {
    "latin": {"f": "Alice Anna Clara Diana Elena Emma Eva Greta Helen Irene Julia Karin Laura Lena Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
              "m": "Adam Alan Bruno Carl Daniel David Erik Felix Frank Georg Hugo Ivan Jonas Karl Leon Lukas Marco Martin Oscar Pablo Paul Peter Simon Victor".split()},
    "cyrillic": {"f": "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(), "m": "Антон Борис Виктор Иван Леонид Максим Олег Павел Роман Юрий".split()},
    "greek": {"f": "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χαρά".split(), "m": "Αλέξης Γιάννης Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Σταύρος".split()},
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ha ka ke la le lo ma me mo na no pa ra re ro sa se ta te to va ve wa".split(),
             "cyrillic": "ба во га де жа за ка ла ме но па ра са то фа ха".split(), "greek": "βα γα δε ζα θε κα λα με νο πα ρα σα τα φα χα".split()}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def kind_of(found: Column, before: Column) -> Column:
    """The type of a match, names with the gender of their form of address; before is the text just in front of it."""
    tail = F.right(before, F.lit(40))
    out = F.when(tail.rlike(f"{CREDENTIAL_BEFORE}$"), "secret")
    for k in ("email", "iban", "ip", "ssn", "card", "phone"):
        out = out.when(found.rlike(f"^(?:{PATTERNS[k]})$"), k)
    for g, titles in TITLES.items():
        out = out.when(tail.rlike(f"\\b{_any_case(titles)}{TITLE_BEFORE}$"), f"name_{g}")
    return out.otherwise("name_n")


def _step(c: Column) -> Column:
    """Initials moved along their alphabet by a keyed step; a letter of no alphabet becomes X."""
    for letters in LETTERS.values():
        by = int(hashlib.sha256(f"{KEY}|{letters}".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
        c = F.translate(c, letters.upper(), (letters[by:] + letters[:by]).upper())
    return F.regexp_replace(c, f"[\\p{{Lu}}&&[^{''.join(x.upper() for x in LETTERS.values())}]]", "X")


def parts_of(kind: Column, found: Column) -> Column:
    """What a mention is made of: (kind, value, found, last), kind null where the text stays as it is."""
    def part(k, v, f, last=F.lit(False)):
        text = lambda x: F.lit(None).cast("string") if x is None else x
        return F.struct(text(k).alias("kind"), text(v).alias("value"), f.alias("found"), last.alias("last"))

    def digits(c):
        return F.regexp_replace(c, "[^0-9]", "")
    local, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.array(part(F.lit("local"), F.lower(local), local), part(None, None, F.lit("@")), part(F.lit("host"), F.lower(host), host), part(None, None, top))
    code = F.regexp_extract(found, f"^{COUNTRY}", 0)
    number = F.substring(found, F.length(code) + 1, F.length(found))
    phone = F.array(part(None, None, code), part(F.lit("phone"), digits(number), number))
    own = f"['’][sS]?(?={GAP}|$)"
    pieces = F.regexp_extract_all(found, F.lit(f"{own}|{GAP}+|(?:(?!{own})[^ \\u00a0])+"), F.lit(0))
    a_word = lambda p: p.rlike("^\\p{Lu}[\\p{L}\\p{M}'’-]+$")
    last = F.aggregate(pieces, F.struct(F.lit(-1).alias("at"), F.lit(0).alias("i")),
                       lambda a, p: F.struct(F.when(a_word(p), a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i")), lambda a: a["at"])
    null = F.lit(None).cast("string")
    name = F.transform(pieces, lambda p, i: part(F.when(a_word(p), F.lit("word")).otherwise(null), F.when(a_word(p), F.lower(p)).otherwise(null),
                                                 F.when(p.rlike("^\\p{Lu}\\.?$"), _step(p)).otherwise(p), i == last))
    value = F.when(kind.isin("card", "ssn"), digits(found)).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).otherwise(found)
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind.startswith("name"), name).otherwise(F.array(part(kind, value, found)))


def _digest(kind: Column, value: Column, draw: Column) -> Column:
    """Hexadecimal digits, as many as a long value needs, by counter."""
    block = lambda i: F.sha2(F.concat_ws("|", F.lit(KEY), F.lit(""), kind, value, draw.cast("string"), i.cast("string")), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(value) + draw) / 16).cast("int")), block), "")


def _number(h: Column, at: Column, size: int = 4) -> Column:
    """A number from the digits of h, place ``at`` (from 0) of blocks of ``size``."""
    return F.conv(F.substring(h, (at * size + 1).cast("int"), F.lit(size)), 16, 10).cast("long")


def _like(value: Column, h: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter or digit replaced by one of its kind, all else kept."""
    def one(c, i):
        r = _number(h, i)
        pick = lambda s: F.substring(F.lit(s), (r % len(s) + 1).cast("int"), F.lit(1))
        out = F.when(c.rlike("[0-9]"), pick("0123456789"))
        if hexadecimal is not None:
            out = F.when(hexadecimal, pick("0123456789abcdef")).when(c.rlike("[0-9]"), pick("0123456789"))
        for s, script in (("latin", "IsLatin"), ("cyrillic", "IsCyrillic"), ("greek", "IsGreek")):
            out = out.when(c.rlike(f"^(?=\\p{{Lu}})\\p{{{script}}}$"), F.upper(pick(LETTERS[s]))).when(c.rlike(f"^(?=\\p{{L}})\\p{{{script}}}$"), pick(LETTERS[s]))
        return out.otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the check digit included."""
    def add(a, x):
        d = x.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((a["t"] + F.when(a["odd"], twice).otherwise(d)).alias("t"), (~a["odd"]).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("t"), F.lit(False).alias("odd")), add, lambda a: a["t"])


def _name(kind: Column, value: Column, h: Column, longer: Column) -> Column:
    """A given name of the list or a family name of four syllables, and ``longer`` syllables more."""
    script = F.when(value.rlike("\\p{IsCyrillic}"), "cyrillic").when(value.rlike("\\p{IsGreek}"), "greek").otherwise("latin")

    def make(s):
        syllables = F.array(*map(F.lit, SYLLABLES[s]))
        more = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(syllables, (_number(h, k + 3, 2) % len(SYLLABLES[s]) + 1).cast("int"))), "")
        pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (_number(h, F.lit(0)) % len(names) + 1).cast("int"))
        given = F.when(kind == "given_f", pick(GIVEN[s]["f"])).when(kind == "given_m", pick(GIVEN[s]["m"])).otherwise(pick(GIVEN[s]["f"] + GIVEN[s]["m"]))
        return F.when(kind == "family", F.initcap(more(longer + 4))).when(longer > 0, F.concat(given, more(longer))).otherwise(given)
    return F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek")).otherwise(make("latin"))


def surrogate(kind: Column, value: Column, draw: Column) -> Column:
    """The replacement of an entity's normal form; every second draw is a sign longer."""
    h, longer = _digest(kind, value, draw), F.floor(draw / 2).cast("int")
    room = F.concat(value, F.repeat(F.when(kind.isin("local", "host", "secret"), "x").otherwise("0"), longer))
    same = _like(room, h)
    octets = F.concat(F.array_join(F.transform(F.split(value, "\\."), lambda _, i: (_number(h, i) % 254 + 1).cast("string")), "."), F.substring(same, F.length(value) + 1, longer))
    body = F.concat(F.substring(value, 1, 1), F.substring(same, F.lit(2), F.length(room) - 2))
    fit = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, F.when(luhn_sum(value) % 10 == 0, fit).otherwise(F.substring(same, -1, 1)))
    zeros = F.length(F.regexp_extract(room, "^0*", 0))  # kept; the sign behind them is 2 to 9
    lead = F.when(zeros < F.length(room), (_number(h, F.lit(0)) % 8 + 2).cast("string")).otherwise("")
    phone = F.concat(F.substring(room, F.lit(1), zeros), lead, F.substring(same, zeros + 2, F.length(room)))
    iban = F.concat(F.substring(value, 1, 2), F.substring(same, F.lit(3), F.length(room)))
    secret = _like(room, h, value.rlike("^[0-9a-f]+$"))
    name = (kind == "family") | kind.startswith("given")
    return (F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "secret", secret).when(name, _name(kind, value, h, longer)).otherwise(same))


def dress(found: Column, kind: Column, plain: Column) -> Column:
    """The surrogate in the mention's own punctuation or case."""
    numbers = kind.isin("card", "phone", "ssn", "iban")
    signs = F.split(found, "")
    use = F.transform(signs, lambda c: c.rlike("[0-9A-Za-z]").cast("int"))
    # each sign that counts takes the next one of the surrogate, what is left follows
    filled = F.aggregate(F.arrays_zip(signs.alias("c"), use.alias("u")), F.struct(F.lit("").alias("t"), F.lit(0).alias("i")), lambda a, x: F.struct(
        F.concat(a["t"], F.when(x["u"] == 1, F.substring(plain, a["i"] + 1, F.lit(1))).otherwise(x["c"])).alias("t"), (a["i"] + x["u"]).alias("i")),
        lambda a: F.concat(a["t"], F.substring(plain, a["i"] + 1, F.length(plain))))
    cased = F.array_join(F.transform(F.split(plain, ""), lambda c, i: F.when(F.get(signs, i).rlike("\\p{Lu}"), F.upper(c)).otherwise(c)), "")
    name = (kind == "family") | kind.startswith("given")
    return F.when(numbers, filled).when(kind.isin("local", "host"), cased).when(name & (found == F.upper(found)), F.upper(plain)).otherwise(plain)


def entity_table(entities: DataFrame) -> DataFrame:
    """kind, value, plain (surrogate) of every distinct (kind, value), without collisions; names of all kinds share one space."""
    space = F.when((F.col("kind") == "family") | F.col("kind").startswith("given"), "name").otherwise(F.col("kind"))
    same = F.when(space == "name", F.lower("plain")).otherwise(F.col("plain"))
    table = entities.select("kind", "value").distinct().withColumn("draw", F.lit(0)).withColumn("plain", surrogate(F.col("kind"), F.col("value"), F.lit(0)))
    table = stage(table.select("*", space.alias("space"), same.alias("same")), "pii-entities")
    own = table.select(F.col("space").alias("s"), F.col("value").alias("v")).distinct()
    while True:
        first = F.row_number().over(Window.partitionBy("space", "same").orderBy("draw", F.xxhash64("kind", "value"), "kind", "value"))
        taken = (F.col("space") == F.col("s")) & (F.col("same") == F.col("v"))
        bad = ((F.col("r") > 1) | F.col("v").isNotNull()).alias("bad")
        marked = stage(table.withColumn("r", first).join(own, taken, "left").select(*table.columns, bad), "pii-entities")
        if marked.filter("bad").isEmpty():
            return marked.select("kind", "value", "plain")
        draw = F.col("draw") + F.col("bad").cast("int")
        again = marked.select("kind", "value", draw.alias("draw"), F.when(F.col("bad"), surrogate(F.col("kind"), F.col("value"), draw)).otherwise(F.col("plain")).alias("plain"))
        table = again.select("*", space.alias("space"), same.alias("same"))


def kinds(parts: DataFrame) -> DataFrame:
    """Each distinct (k, v, g) of the parts and its kind: words of names are family or given names by how they are used in the corpus."""
    used = parts.groupBy("k", "v", "g").agg(F.sum(F.col("last").cast("long")).alias("__last"), F.count(F.lit(1)).alias("__n"))
    word = Window.partitionBy("k", "v")
    total = lambda c: F.sum(c).over(word)
    listed = {g: F.col("v").isin([x.lower() for s in GIVEN.values() for x in s[g]]) for g in "fm"}
    given = total(F.col("__n") - F.col("__last")) > total(F.col("__last"))
    tied = total(F.col("__n") - F.col("__last")) == total(F.col("__last"))
    balance = total(F.when(F.col("g") == "f", F.col("__n")).when(F.col("g") == "m", -F.col("__n")).otherwise(0))
    gender = (F.when(F.col("g") != "n", F.col("g")).when(balance > 0, "f").when(balance < 0, "m").when(listed["f"], "f").when(listed["m"], "m").otherwise("n"))
    kind = (F.when(F.col("k") != "word", F.col("k")).when(given | (tied & (listed["f"] | listed["m"])), F.concat(F.lit("given_"), gender)).otherwise("family"))
    return used.select("k", "v", "g", kind.alias("kind"))


def replace_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with entities replaced, and n_entities."""
    cols = [c for c in docs.columns if c != "n_entities"]
    # own columns are numbered away from those of the input
    free = next(p for p in (f"__pii{i or ''}_" for i in range(len(cols) + 1)) if not any(c.startswith(p) for c in cols))
    rid, found, gaps = free + "rid", free + "found", free + "gaps"
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    d = docs.select(*cols, F.when(hinted, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias(found))
    d = stage(d.withColumn(rid, F.monotonically_increasing_id()), "pii-docs")
    some = d.filter(F.size(found) > 0).withColumn(gaps, F.split(F.col(text), ANY, -1))
    at = (some.select(F.col(rid).alias("rid"), F.posexplode(F.arrays_zip(F.col(found).alias("found"), F.slice(gaps, 1, F.size(found)).alias("before"))).alias("at", "x"))
          .select("rid", "at", F.col("x.found").alias("found"), kind_of(F.col("x.found"), F.col("x.before")).alias("kind")))
    gender = F.when(F.col("kind").startswith("name_"), F.right(F.col("kind"), F.lit(1))).otherwise("")
    parts = at.select("rid", "at", gender.alias("g"), F.posexplode(parts_of(F.col("kind"), F.col("found"))).alias("j", "x"))
    parts = stage(parts.select("rid", "at", "j", "g", F.col("x.kind").alias("k"), F.col("x.value").alias("v"), F.col("x.found").alias("f"), F.col("x.last").alias("last")), "pii-parts")
    entities = stage(kinds(parts.filter("k is not null")), "pii-kinds")
    table = entity_table(entities.select("kind", F.col("v").alias("value")))
    lookup = entities.join(table.withColumnRenamed("value", "v"), ["kind", "v"])
    drawn = parts.filter("k is not null").join(lookup, ["k", "v", "g"]).select("rid", "at", "j", dress(F.col("f"), F.col("kind"), F.col("plain")).alias("s"))
    kept = parts.filter("k is null").select("rid", "at", "j", F.col("f").alias("s"))
    new = drawn.unionByName(kept).groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list(F.struct("at", "j", "s"))).alias(free + "new"))
    joined = some.join(new, rid)
    filled = F.transform(free + "new", lambda x: F.concat(F.when(x["j"] == 0, F.get(F.col(gaps), x["at"])).otherwise(""), x["s"]))
    whole = F.concat(F.array_join(filled, ""), F.get(F.col(gaps), F.size(found)))
    changed = joined.withColumn(text, whole).withColumn("n_entities", F.size(found))
    rest = d.filter(F.coalesce(F.size(found), F.lit(0)) <= 0).withColumn("n_entities", F.lit(0))
    out = changed.select(*cols, "n_entities").unionByName(rest.select(*cols, "n_entities"))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
