"""Personal data replaced by surrogates.

One pattern finds e-mail and IP addresses, account, card, social-security and phone
numbers and persons after a form of address. Every distinct value gets one surrogate
from a keyed hash, of the same type: the shape of letters, digits and separators is kept,
card numbers keep a valid check digit, names keep script, gender and capitals. Equal
values therefore stay equal everywhere (coreference). Surrogates that meet another one
or a real value of the corpus are drawn again; the few that a full space leaves trade
places, so all are distinct.

DataFrame functions only. Distinct values combine before the shuffle, so a value that
stands in a third of the texts is one row; only texts with personal data are joined to
their few replacements, by id, which is never hot; other texts pass straight through.

Defined cases: a null text stays null with no entities, an empty one empty. Repeated rows
give equal rows. Rows with a null id are joined by the digest of their text. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketspark.operators.ranking import ranked_rows
from marketspark.session import stage

# Fixed forms of address, by gender.
ADDRESS = {
    "m": "Mr|Herr|Monsieur|Señor|Sr|Sir", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|Lady", "n": "Dr|Prof",
    "mc": "господин|г-н|κύριος|κ", "fc": "госпожа|г-жа|κυρία|κα",
}
#: First letters of the forms of address, so that the pattern is not tried elsewhere.
INITIALS = "".join(sorted({form[0] for forms in ADDRESS.values() for form in forms.split("|")}))
#: Patterns in order of preference. Only single characters repeat without a bound: Java matches a repeated group by recursion.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9-]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "card": r"(?<![\d+])(?:\d{4}(?:[ -]?\d{4}){3}|\d{13,19})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "person": rf"(?=[{INITIALS}])(?<!\p{{L}})(?:" + "|".join(ADDRESS.values()) + r")\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match holds; tells cheaply that a text has nothing to find.
HINT = "[0-9@]|" + PATTERNS["person"]
#: Syllables of made-up names, and the endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mi mo na ne no pa pe ra re ro sa se ta te va".split(),
    "cyrillic": "ба бе бо да де до фа фе га ге ка ке ла ле ло ма ме ми мо на не но па пе ра ре ро са се та те ва".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γε κα κε λα λε λο μα με μι μο να νε νο πα πε ρα ρε ρο σα σε τα τε ζα".split(),
}
ENDINGS = {"latin": {"m": "rik", "f": "nia", "n": "lin"}, "cyrillic": {"m": "рик", "f": "ния", "n": "лин"}, "greek": {"m": "νος", "f": "νια", "n": "λιν"}}
NUMBERS = ("card", "ssn", "phone")
ROUNDS = (1, 4, 16, 64)  # draws of each round


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def entity_type(surface: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        kind = F.when(F.rlike(surface, F.lit(f"^(?:{PATTERNS[name]})$")), F.lit(name)).otherwise(kind)
    return kind


def canonical(kind: Column, surface: Column) -> Column:
    """The value without its spelling: digits of numbers, lower case of addresses, a person without the form of address."""
    name = F.regexp_replace(surface, "^(?:" + "|".join(ADDRESS.values()) + r")\.? ", "")
    return (
        F.when(kind.isin(*NUMBERS), _digits(surface)).when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "person", F.lower(name)).otherwise(F.lower(surface))
    )


def gender(surface: Column) -> Column:
    def starts(*keys):
        return F.rlike(surface, F.lit("^(?:" + "|".join(ADDRESS[k] for k in keys) + r")\.? "))

    return F.when(starts("f", "fc"), F.lit("f")).when(starts("m", "mc"), F.lit("m"))


def _stream(key: str, *parts: Column) -> Column:
    """128 hex digits that only the key's holder can compute."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1f0")), 256), F.sha2(F.concat(seed, F.lit("\x1f1")), 256))


def _byte(stream: Column, i: Column | int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(stream, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda within refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shaped(value: Column, stream: Column, kept: int = 0) -> Column:
    """``value`` with letters and digits drawn anew beyond the first ``kept`` characters."""
    return _let(stream, lambda drawn: _drawn_anew(value, drawn, kept))


def _drawn_anew(value: Column, stream: Column, kept: int) -> Column:
    def one(c: Column, i: Column) -> Column:
        def pick(symbols: str) -> Column:
            return F.substr(F.lit(symbols), F.pmod(_byte(stream, i), F.lit(len(symbols))) + 1, F.lit(1))

        drawn = (
            F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789")).when(F.rlike(c, F.lit("[a-z]")), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(F.rlike(c, F.lit("[A-Z]")), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )
        return F.when(i < kept, c).otherwise(drawn)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum modulo 10 of a number's digits, every second one from the right doubled."""
    reversed_digits = _chars(F.reverse(digits))
    terms = F.transform(reversed_digits, lambda c, i: F.when(i % 2 == 1, (2 * c.cast("int")) - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10


def _card(canon: Column, stream: Column) -> Column:
    drawn = _shaped(canon, stream, 1)
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn_sum(canon) == 0, F.concat(body, check)).otherwise(drawn)


def _email(canon: Column, stream: Column, key: str) -> Column:
    local, host = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    return F.concat(_shaped(local, stream), F.lit("@"), _shaped(F.regexp_replace(host, r"\.[^.]+$", ""), _stream(key, F.lit("host"), host)), F.lit(".example"))


def _ip(stream: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(_byte(stream, i), F.lit(254)) + 1).cast("string") for i in range(4)])


def _person(canon: Column, known: Column, stream: Column) -> Column:
    script = F.when(F.rlike(canon, F.lit(r"\p{IsCyrillic}")), F.lit("cyrillic")).when(F.rlike(canon, F.lit(r"\p{IsGreek}")), F.lit("greek")).otherwise(F.lit("latin"))

    def made(name: str) -> Column:
        symbols = F.array(*[F.lit(s) for s in SYLLABLES[name]])

        def syllables(*at: int) -> Column:
            return F.concat(*[F.get(symbols, F.pmod(_byte(stream, i), F.lit(len(SYLLABLES[name])))) for i in at])

        ending = F.when(known == "m", ENDINGS[name]["m"]).when(known == "f", ENDINGS[name]["f"]).otherwise(ENDINGS[name]["n"])
        return F.when(F.contains(canon, F.lit(" ")), F.concat(syllables(0, 1), ending, F.lit(" "), syllables(2, 3, 4, 5))).otherwise(syllables(2, 3, 4, 5))

    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def surrogate(key: str, kind: Column, canon: Column, known: Column, attempt: Column) -> Column:
    """Canonical surrogate of a canonical value."""
    stream = _stream(key, kind, canon, attempt.cast("string"))
    return (
        F.when(kind == "email", _email(canon, stream, key)).when(kind == "ip", _ip(stream)).when(kind == "card", _card(canon, stream))
        .when(kind == "iban", _shaped(canon, stream, 2)).when(kind == "person", _person(canon, known, stream))
        .when(kind == "ssn", _shaped(canon, stream)).otherwise(_shaped(canon, stream, 1))
    )


def _kind_of_shape(kind: Column, canon: Column, known: Column) -> Column:
    """What a surrogate must keep: type, gender, script and the places of digits and letters."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    script = F.when(F.rlike(canon, F.lit(r"\p{IsCyrillic}")), "c").when(F.rlike(canon, F.lit(r"\p{IsGreek}")), "g").otherwise("l")
    return F.concat_ws("|", kind, F.coalesce(known, F.lit("-")), F.when(kind == "person", F.concat(script, F.contains(canon, F.lit(" ")).cast("string"))).otherwise(shape))


def _exchanged(left: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) where a space is all but full: values of one shape trade places in a keyed order.

    Each takes the next one's value, so surrogates are distinct and differ from those
    drawn, none of which is a real value. A value alone in its shape gets sixteen digits more.
    """
    kind, canon, known = F.col("kind"), F.col("canon"), F.col("known")
    placed = left.select("kind", "canon", "known", _kind_of_shape(kind, canon, known).alias("shape"), _stream(key, F.lit("order"), kind, canon).alias("order"))
    numbered = stage(ranked_rows(placed, ["shape"], ["order", "canon"], "nth", "n"))
    after = numbered.select(F.col("shape").alias("_shape"), F.col("nth").alias("_nth"), F.col("canon").alias("_next"))
    met = numbered.join(after, (F.col("shape") == F.col("_shape")) & (F.col("nth") % F.col("n") + 1 == F.col("_nth")))
    digits = F.concat(*[F.pmod(_byte(F.col("order"), i), F.lit(10)).cast("string") for i in range(16)])
    drawn = surrogate(key, kind, canon, known, F.lit(0))
    longer = F.when(kind == "email", F.concat(F.substring_index(drawn, "@", 1), digits, F.lit("@"), F.substring_index(drawn, "@", -1))).otherwise(F.concat(drawn, digits))
    return met.select("kind", "canon", F.when(F.col("n") > 1, F.col("_next")).otherwise(longer).alias("surrogate"))


def distinct_surrogates(values: DataFrame, key: str, rounds: Sequence[int] = ROUNDS) -> DataFrame:
    """(kind, canon, surrogate): one surrogate per value, no two alike.

    A draw that meets another surrogate or a real value does not count; each of
    ``rounds`` draws so often. What is left stands in a space that is all but full, as
    that of five-digit numbers that all occur, and trades places there: only then is a
    surrogate the real value of another.
    """
    real = values.select(F.col("kind").alias("_kind"), F.col("canon").alias("_real"))
    pending, accepted, before = values, [], 0
    for draws in rounds:
        tries = pending.withColumn("attempt", F.explode(F.sequence(F.lit(before), F.lit(before + draws - 1))))
        drawn = tries.select("kind", "canon", "attempt", surrogate(key, F.col("kind"), F.col("canon"), F.col("known"), F.col("attempt")).alias("surrogate"))
        taken = reduce(DataFrame.unionByName, [real, *(a.select(F.col("kind").alias("_kind"), F.col("surrogate").alias("_real")) for a in accepted)])
        free = drawn.join(taken, (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("_real")), "left_anti")
        first = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("canon", "attempt"))
        won = free.withColumn("first", first).where("first = 1").groupBy("kind", "canon").agg(F.min_by("surrogate", "attempt").alias("surrogate"))
        accepted.append(stage(won))
        got = accepted[-1].select(F.col("kind").alias("_kind"), F.col("canon").alias("_canon"))
        pending = stage(pending.join(got, (F.col("kind") == F.col("_kind")) & (F.col("canon") == F.col("_canon")), "left_anti"))
        before += draws
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, accepted)
    return reduce(DataFrame.unionByName, [*accepted, _exchanged(pending, key)])


def spelled(kind: Column, surface: Column, replacement: Column) -> Column:
    """The surrogate in the spelling of a mention: separators, capitals and form of address."""
    filled = F.aggregate(
        _chars(surface), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda a, c: F.when(F.rlike(c, F.lit("[0-9A-Za-z]")), F.struct(F.concat(a["out"], F.substr(replacement, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))), lambda a: a["out"],
    )
    address = F.regexp_extract(surface, "^(?:" + "|".join(ADDRESS.values()) + r")\.? ", 0)
    name = F.regexp_replace(surface, "^(?:" + "|".join(ADDRESS.values()) + r")\.? ", "")
    cased = F.when((name == F.upper(name)) & (F.length(name) > 1), F.upper(replacement)).otherwise(F.initcap(replacement))
    mail = F.when(surface == F.upper(surface), F.upper(replacement)).otherwise(replacement)
    return F.when(kind.isin(*NUMBERS, "iban"), filled).when(kind == "person", F.concat(address, cased)).when(kind == "email", mail).otherwise(replacement)


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_entities, text) of every row, with all personal data replaced."""
    text = F.col(text_col).cast("string")
    found = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("mentions")
    )
    some = found.where(F.size("mentions") > 0)
    joined_by = F.coalesce(F.col("id").cast("string"), F.sha2("text", 256))
    surfaces = some.select(joined_by.alias("row"), F.explode(F.array_distinct("mentions")).alias("surface"))
    surfaces = stage(
        surfaces.withColumn("kind", entity_type(F.col("surface"))).where("kind IS NOT NULL").withColumn("canon", canonical(F.col("kind"), F.col("surface")))
    )
    values = stage(surfaces.groupBy("kind", "canon").agg(F.max(F.when(F.col("kind") == "person", gender(F.col("surface")))).alias("known")))
    named = stage(distinct_surrogates(values, key))
    told = surfaces.join(named, ["kind", "canon"]).select("row", "surface", spelled(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("spelled"))
    by_row = told.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("surface", "spelled"))).alias("told"))
    pieces = some.select("id", "text", "mentions", joined_by.alias("_row"), F.split("text", ANY, -1).alias("between"))
    rebuilt = pieces.join(by_row, F.col("_row") == F.col("row"), "left").select(
        "id", F.size("mentions").cast("long").alias("n_entities"),
        F.array_join(
            F.transform("between", lambda part, i: F.concat(F.when(i == 0, F.lit("")).otherwise(_told(i)), part)), ""
        ).alias("text"),
    )
    clean = found.where(F.size("mentions") == 0).select("id", F.lit(0).cast("long").alias("n_entities"), "text")
    return clean.unionByName(rebuilt).withColumnRenamed("id", id_col)


def _told(i: Column) -> Column:
    mention = F.get("mentions", i - 1)
    return F.coalesce(F.try_element_at(F.col("told"), mention), mention)
