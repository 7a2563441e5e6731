"""Personal data replaced by keyed surrogates of the same type and format.

Everything on the executors is DataFrame functions: entities are found by
patterns, each distinct entity gets a surrogate from a keyed hash, surrogates are
checked for collisions over the whole corpus, and texts are put together again
from what stands between the entities.

A person's name is replaced word by word: a surname has one surrogate, a given
name one for each gender. So a full name, a surname behind a title and a bare
name in the same text stay one person, Mr and Mrs of one surname stay two, and
two different names never become one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import located, staged

KEY = "surrogates"
#: Rounds of draws from the ranges set aside; what still collides draws from all values of its format.
ROUNDS = 4

# Forms of address and given names, by gender and script.
FEMALE_TITLES = "Mrs Ms Miss Frau Mme Madame Mlle Señora Sra Doña Lady Госпожа госпожа Г-жа г-жа Κυρία κυρία".split()
MALE_TITLES = "Mr Herr Monsieur Señor Sr Don Sir Господин господин Г-н г-н Κύριος κύριος Κύριο κύριο".split()
OTHER_TITLES = "Dr Prof Mx".split()
GIVEN = {
    "f": "Alma Clara Dora Edith Flora Greta Hilda Irma Julia Klara Laura Marta Nora Olga Paula Rosa Silvia Thea Ursula Vera".split(),
    "m": "Adam Boris Conrad David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Otto Paul Ruben Simon Theo Victor".split(),
    "u": "Alex Andy Casey Charlie Chris Dana Eli Jamie Jules Kim Kit Lee Lou Noa Pat Robin Sam Sascha Toni Val".split(),
}
SURNAMES = "Abbott Becker Castle Dumont Ebert Fischer Garner Holt Iverson Jansen Keller Lambert Morris Navarro Olsen Porter Quinn Roland Sommer Torres".split()
# Letters of names in the scripts that stand for these Latin ones.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"c": "абкдефгхижклмнопкрстуввксиз", "g": "αβκδεφγχιζκλμνοπκρστυββξυζ"}
_ONSETS = "b d f g h k l m n p r s t v br dr gr kl st tr".split()
_VOWELS = "a e i o u".split()

_TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_TITLE = rf"(?:(?:{_TITLES})\.?|M\.) "
_NAME = r"\p{Lu}[\p{L}'-]++"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: (type, pattern), the first that fits at a place wins. Repeated groups give nothing back, so no text makes them recurse or try again.
PATTERNS = (
    ("hex", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
    ("secret", r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}+)(?![0-9A-Za-z])"),
    ("email", r"(?<![\w.+-])[\w+-]++(?:\.[\w+-]++)*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]?\d)"),
    ("ip6", rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}:(?:{_HEX}(?::{_HEX}){{0,4}}+)?)(?![0-9A-Za-z:])"),
    ("card", r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{3,4}(?![\d-])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d\p{L}+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\d-])|(?<![\d\p{L}])\+\d{8,14}(?!\d)"),
    ("name", rf"(?<![\p{{L}}]){_TITLE}{_NAME}(?: {_NAME}){{0,2}}+"),
)
_TITLED = rf"^{_TITLE}"
#: A word that may be the name of somebody the text has named before or after.
_BARE = rf"(?<![\p{{L}}]){_NAME}"
# Country calling codes of one and two digits; all others have three.
_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_NUMBERS = ("card", "ssn", "phone")


def _any(patterns) -> str:
    out, groups = [], 0
    for p in patterns:
        out.append("(?:" + p.replace(r"\1", rf"\{groups + 1}") + ")")
        groups += p.replace("(?", "").count("(") - p.replace("(?", "").count(r"\(")
    return "|".join(out)


ANY = _any(p for _, p in PATTERNS)
ANY_OR_BARE = _any([*(p for _, p in PATTERNS), _BARE])


def _type_of(value: Column) -> Column:
    kind = F.lit("bare")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(value.rlike("^(?:" + pattern + ")$"), name).otherwise(kind)
    return kind


def _canonical(kind: Column, value: Column) -> Column:
    """What two mentions of one entity have in common; digits of a number, behind a + where it starts with one."""
    digits = F.concat(F.when(value.startswith("+"), "+").otherwise(""), F.regexp_replace(value, r"\D", ""))
    return (
        F.when(kind.isin("email", "ip6", "surname", "given"), F.lower(value)).when(kind.isin(*_NUMBERS), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(value)
    )


def _number(digest: Column, at: int, size: int = 7) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("long")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _likened(text: Column, seed: Column) -> Column:
    """``text`` with each digit, small and capital letter drawn anew within its class; all else as it is."""
    classes = (("[0-9]", "0123456789"), ("[a-z]", LATIN), ("[A-Z]", LATIN.upper()))

    def drawn(c: Column, i: Column) -> Column:
        # two bytes of a digest of the position's block
        n = F.conv(F.substring(F.sha2(F.concat(seed, F.floor(i / 16).cast("string")), 256), (F.pmod(i, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
        out = c
        for shape, values in classes:
            out = F.when(c.rlike(shape), F.substring(F.lit(values), (n % len(values) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), drawn), "")


def _syllables(digest: Column, start: int, count: int) -> Column:
    return F.concat(*[F.concat(_pick(_ONSETS, _number(digest, start + 8 * k, 4)), _pick(_VOWELS, _number(digest, start + 8 * k + 4, 4))) for k in range(count)])


def _word(kind: Column, gender: Column, script: Column, digest: Column, draw: Column) -> Column:
    """A name: from the lists first, then with a second part, then from syllables with the gender's ending."""
    given = F.when(gender == "f", _pick(GIVEN["f"], _number(digest, 1))).when(gender == "m", _pick(GIVEN["m"], _number(digest, 1))).otherwise(_pick(GIVEN["u"], _number(digest, 1)))
    other = F.when(gender == "f", _pick(GIVEN["f"], _number(digest, 9))).when(gender == "m", _pick(GIVEN["m"], _number(digest, 9))).otherwise(_pick(GIVEN["u"], _number(digest, 9)))
    ending = F.when(gender == "f", _pick(["na", "lia", "ra", "ska"], _number(digest, 60, 4))).when(gender == "m", _pick(["n", "r", "d", "s"], _number(digest, 60, 4))).otherwise("")
    made = F.concat(_syllables(digest, 17, 3), F.when(draw >= ROUNDS, _syllables(digest, 41, 2)).otherwise(""))
    given = F.when(draw == 0, given).when(draw == 1, F.concat(given, F.lit("-"), other)).otherwise(F.initcap(F.concat(made, ending)))
    surname = F.when(draw == 0, _pick(SURNAMES, _number(digest, 1))).otherwise(F.initcap(F.concat(made, _pick(["n", "r", "l", "ck", "man", "sen", "ton", "berg"], _number(digest, 60, 4)))))
    out = F.when(kind == "given", given).otherwise(surname)
    for name, letters in SCRIPTS.items():
        letters = letters[: len(LATIN)]
        out = F.when(script == name, F.translate(out, LATIN + LATIN.upper(), letters + letters.upper())).otherwise(out)
    return out


def _identity(kind: Column, gender: Column, script: Column, canonical: Column, draw: Column, key: str) -> Column:
    """The surrogate's content, of the entity's kind: digits, hex digits, a mailbox or a word of a name.

    Numbers that must not be anybody's stand in ranges set aside for examples
    where there are such ranges (192.0.2/24 is too narrow, so 10/8 is used). From
    draw ``ROUNDS`` on they take all values of the format, since a range can be full.
    """
    seed = F.concat_ws("\x1f", F.lit(key), kind, gender, canonical, draw.cast("string"))
    digest = F.sha2(seed, 256)
    crowded = draw >= ROUNDS
    octets = [(_number(digest, k, 4) % 256).cast("string") for k in (1, 5, 9)]
    net = F.when(crowded, (_number(digest, 13, 4) % 256).cast("string")).otherwise("10")
    groups = [F.ltrim(F.substring(digest, k, 4), F.lit("0")) for k in (1, 5, 9, 13, 17, 21)]
    groups = [F.when(g == "", "0").otherwise(g) for g in groups]
    secret = F.regexp_extract(canonical, r"^(AKIA|gh[pousr]_|sk-(?:ant-|proj-)?)", 1)
    rest = F.substr(canonical, F.length(secret) + 1)
    # a phone keeps its country's code and leading zeros, a card and an IBAN what says whose they are
    head = (
        F.when((kind == "phone") & (~crowded | canonical.startswith("+")), F.regexp_extract(canonical, rf"^(\+(?:(?:{_CODES})|\d{{3}})|0*)", 1))
        .when((kind == "card") & ~crowded, F.lit("0000")).when((kind == "ssn") & ~crowded, F.lit("9"))
        .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), F.when(crowded, "").otherwise("00"))).otherwise("")
    )
    tail = _likened(F.substr(canonical, F.length(head) + 1), seed)
    return (
        F.when(kind == "email", F.concat(F.lower(_pick(SURNAMES, _number(digest, 1))), F.lit("."), F.substring(digest, 8, 10), F.lit("@example.invalid")))
        .when(kind == "ip", F.concat_ws(".", net, *octets))
        .when(kind == "ip6", F.concat_ws(":", F.lit("2001:db8"), *groups))
        .when(kind == "hex", F.substr(F.concat(digest, F.sha2(digest, 256)), F.lit(1), F.length(canonical)))
        .when(kind == "secret", F.concat(secret, _likened(rest, seed)))
        .when(kind.isin("given", "surname"), _word(kind, gender, script, digest, draw))
        .otherwise(F.concat(head, tail))
    )


def _formatted(kind: Column, value: Column, content: Column) -> Column:
    """The content in the mention's own format: punctuation and spaces of numbers, capitals of names."""
    marks = F.filter(F.split(value, ""), lambda c: c != "")
    bare = F.regexp_replace(content, r"^\+", "")

    def laid(shape: str, content: Column) -> Column:
        # every digit of the mention takes the next digit of the content
        return F.aggregate(
            marks, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda acc, c: F.struct(
                F.concat(acc["out"], F.when(c.rlike(shape), F.substring(content, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
                (acc["at"] + F.when(c.rlike(shape), 1).otherwise(0)).alias("at"),
            ),
            lambda acc: acc["out"],
        )

    capitals = (F.length(value) > 1) & (value == F.upper(value))
    return (
        F.when(kind.isin(*_NUMBERS), laid("[0-9]", bare)).when(kind == "iban", laid("[0-9A-Z]", content))
        .when(kind.isin("given", "surname") & capitals, F.upper(content)).otherwise(content)
    )


def _gender(value: Column) -> Column:
    """f, m, or u where the form of address does not tell."""
    title = F.regexp_extract(value, r"^([\p{L}-]+)", 1)
    return F.when(title.isin(FEMALE_TITLES), "f").when(title.isin([*MALE_TITLES, "M"]), "m").otherwise("u")


def surrogates(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canonical, gender, content) for the distinct ``entities(kind, canonical, gender, script)``.

    A surrogate that two entities drew, or that is itself an entity of the
    corpus, stays with the first of them in order of canonical form (with none
    in the second case); the others draw again until none is left. The first
    ``rounds`` draws keep to the ranges set aside. A format with fewer values than
    the corpus has entities of it cannot keep them apart: that is an error.
    """
    rows = entities.groupBy("kind", "canonical", "gender").agg(F.min("script").alias("script"))
    rows = staged(rows, "pii-entities")
    real = rows.select("kind", F.col("canonical").alias("form"))
    mine = ["kind", "canonical", "gender"]
    done, left, turn, before = None, rows, 0, -1
    while True:
        draw = F.lit(turn if turn < rounds else max(turn, ROUNDS))
        content = _identity(F.col("kind"), F.col("gender"), F.col("script"), F.col("canonical"), draw, key)
        drawn = staged(left.withColumn("content", content), "pii-drawn")
        form = _canonical(F.col("kind"), F.col("content"))
        drawn = drawn.withColumn("form", form)
        taken = real if done is None else real.union(done.select("kind", "form"))
        free = drawn.join(taken, ["kind", "form"], "left_anti")
        first = free.groupBy("kind", "form").agg(F.min(F.struct("canonical", "gender")).alias("first"))
        new = free.join(first, ["kind", "form"]).where("canonical = first.canonical AND gender = first.gender").select(*mine, "content", "form")
        done = staged(new if done is None else done.unionByName(new), "pii-surrogates")
        left = rows.join(done, mine, "left_anti")
        if left.isEmpty():
            return done.select(*mine, "content")
        turn += 1
        if turn % 32 == 0:
            # hardly ever reached; in 32 rounds a format with free values gives some away
            open_ = left.count()
            if open_ == before:
                raise ValueError(f"{open_} entities find no free value of their format in {turn} draws")
            before = open_


def _parts(mentions: DataFrame) -> DataFrame:
    """``mentions(file, row, value, kind)`` by the entities in them: (.., at, word, role, gender, known).

    A titled name has one row per word: all but the last are given names. Its
    title's gender holds for its given names; one without a gender takes that which
    the same given name has in the same text, where it has just one. A bare word
    has a row where the text names somebody so behind a title.
    """
    place = ["file", "row"]
    titled = mentions.where("kind = 'name'").withColumn("gender", _gender(F.col("value")))
    words = titled.select(*place, "value", "gender", F.posexplode(F.split(F.regexp_replace("value", _TITLED, ""), " ")).alias("at", "word"), F.size(F.split(F.regexp_replace("value", _TITLED, ""), " ")).alias("n"))
    words = words.withColumn("role", F.when(F.col("at") == F.col("n") - 1, "surname").otherwise("given")).withColumn("low", F.lower("word"))
    named = words.groupBy(*place, "role", "low").agg(F.collect_set(F.when(F.col("gender") != "u", F.col("gender"))).alias("genders"))
    sole = F.when((F.col("role") == "given") & (F.size("genders") == 1), F.element_at("genders", 1))
    some = F.when((F.col("role") == "given") & (F.size("genders") > 0), F.array_min("genders"))
    named = named.select(*place, "role", "low", F.coalesce(sole, F.lit("u")).alias("sole"), F.coalesce(some, F.lit("u")).alias("some"))
    own = F.when(F.col("role") == "surname", "").when(F.col("gender") != "u", F.col("gender")).otherwise(F.col("sole"))
    spelt = words.join(named, [*place, "role", "low"]).select(*place, "value", "at", "word", "role", own.alias("gender"))
    # a bare word that is a surname and a given name of the text counts as the surname
    called = named.groupBy(*place, "low").agg(F.max(F.struct("role", F.col("some").alias("gender"))).alias("is"))
    bare = mentions.where("kind = 'bare'").withColumn("low", F.lower("value")).join(called, [*place, "low"])
    bare = bare.select(*place, "value", F.lit(0).alias("at"), F.col("value").alias("word"), F.col("is.role").alias("role"), F.when(F.col("is.role") == "given", F.col("is.gender")).otherwise("").alias("gender"))
    rest = mentions.where("kind NOT IN ('name', 'bare')").select(*place, "value", F.lit(0).alias("at"), F.col("value").alias("word"), F.col("kind").alias("role"), F.lit("").alias("gender"))
    return spelt.unionByName(bare).unionByName(rest)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, entities), one row per document.

    ``text`` is the whole text with every entity replaced, null counting as
    empty; what is no entity stays as it is. ``entities`` are the documents'
    distinct (kind, surrogate), sorted; a name's kind is ``name`` and its surrogate
    has no title. A surrogate depends on the key and the entity only, so repeated
    rows have one result and reruns agree; an empty table gives no rows, and other
    columns are not read.

    Kept are: length, punctuation and country code of phone numbers; punctuation
    of cards, social security numbers and IBANs (and the country of these); the
    prefix, length and classes of characters of keys; title, gender, capitals and
    script (Latin, Cyrillic, Greek) of names. E-mail addresses go to a domain that
    cannot exist, addresses of the internet to 10/8 and 2001:db8/32.

    Names are found behind a form of address, and in the same text without one,
    whole or in part; a text that never uses a form of address keeps its names.
    """
    value, place = F.col("value"), ["file", "row"]
    rows = located(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *place)
    found = rows.withColumn("values", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    hit = staged(found.where(F.size("values") > 0), "pii-texts")
    names = F.exists("values", lambda v: v.rlike(_TITLED))
    more = hit.where(names).withColumn("values", F.regexp_extract_all("text", F.lit(ANY_OR_BARE), F.lit(0)))
    both = hit.where(~names).select("doc_id", *place, "values", F.split("text", ANY, -1).alias("between")).unionByName(
        more.select("doc_id", *place, "values", F.split("text", ANY_OR_BARE, -1).alias("between"))
    )
    mentions = both.select(*place, F.explode(F.array_distinct("values")).alias("value")).withColumn("kind", _type_of(value))
    parts = staged(_parts(staged(mentions, "pii-mentions")), "pii-parts").withColumn("canonical", _canonical(F.col("role"), F.col("word")))
    script = F.when(F.col("word").rlike(r"\p{IsCyrillic}"), "c").when(F.col("word").rlike(r"\p{IsGreek}"), "g").otherwise("l")
    table = surrogates(parts.select(F.col("role").alias("kind"), "canonical", "gender", script.alias("script")).distinct(), key)
    put = parts.join(table.withColumnRenamed("kind", "role"), ["role", "canonical", "gender"]).withColumn("new", _formatted(F.col("role"), F.col("word"), F.col("content")))
    put = put.groupBy(*place, "value").agg(F.min("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new"))
    kind = F.when(F.col("role").isin("given", "surname"), "name").otherwise(F.col("role"))
    put = put.select(*place, "value", kind.alias("kind"), F.col("new").alias("surrogate"), F.concat(F.regexp_extract("value", rf"({_TITLED})", 1), "new").alias("new"))
    maps = put.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("map"), F.array_sort(F.collect_set(F.struct("kind", "surrogate"))).alias("entities"))
    after = F.concat(F.transform("values", lambda v: F.coalesce(F.element_at("map", v), v)), F.array(F.lit("")))
    text = F.array_join(F.zip_with("between", after, lambda a, b: F.concat(a, b)), "")
    count = F.size(F.filter("values", lambda v: F.map_contains_key("map", v))).cast("long")
    changed = both.join(maps, place).select("doc_id", text.alias("text"), count.alias("n_entities"), "entities")
    same = found.where(F.size("values") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast(changed.schema["entities"].dataType).alias("entities"))
    return changed.unionByName(same)
