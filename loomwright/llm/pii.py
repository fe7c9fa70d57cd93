"""Surrogates for personal data, in DataFrame expressions only.

E-mail addresses, telephone numbers, IP addresses (both versions), card and account numbers, secrets and names are replaced
by keyed surrogates of the same type, script and format.

Names are found after a title, or by a given name of the lists below before a capitalised word, and from then on wherever a
word of them occurs in the same text, in capitals too; words that are common words as well (FAMILIAR) only within a name.
Given names of the lists get another name of their list, so gender and script stay; other words are permuted letter by letter, the last
letter of a cased word of three letters or more staying, as it carries gender in many languages. Everything is done word by
word under one key, so that "Mr John Smith", "John" and "Smith" agree.

A permutation moves each character within its alphabet (its case and script; vowels and consonants apart where fixed) by
a keyed hash of the characters before it, and the first one by 1 or more: it is one-to-one and has no fixed point. So
equal originals have equal surrogates wherever they occur (coreference), different ones have different surrogates
(distinctness), and no original stays. Alphabets cover every letter of Unicode. Cards keep their first digit and a valid
checksum; numbers without one are no cards. Account numbers (IBAN) keep their country and a valid checksum, too; secrets of
known services keep their prefix. surrogates() checks distinctness over all entities of the corpus from what it
wrote, and gives colliding ones (which two kinds of name words can make) surrogates of another key until none is left.

Defined results: a null text stays null; a text without entities stays as it is, byte for byte; of overlapping entities
the leftmost counts, at one place the first of the list below; marks, hyphens and apostrophes of a name stay; texts of
any length are read whole; repeated rows, null and repeated ids have no influence; further columns stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: The setting of a session that holds the key. Whoever knows the key can undo the permutations: keep it secret.
KEY_SETTING = "loomwright.pii.key"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Captain|Capt|Sir|Judge|Senator|Herrn|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Sr"
#: Words that follow or are like names, but are common words.
FAMILIAR = "May|April|June|August|Will|Rose|Grace|Hope|Mark|Rich|Young|Long|Short|Brown|Green|White|Black|King|Street|Road|Avenue|Lane|Square|Park|Hall|House|University|Bridge|The|And|But|For|In|On|At|Of|It|He|She|They|We|Is|Was|Has|Die|Der|Das|Und|Le|La|Les|El|Los"
PLACES = "Street|Road|Avenue|Lane|Square|Park|Hall|House|University|Bridge"
#: Given names by gender and script: a name gets the one that a keyed, never empty, step away stands in its row.
GIVEN_NAMES = (
    "Adam Alan Albert Andrew Anthony Arthur Ben Brian Carl Charles Christian David Dennis Edward Eric Felix Frank George Hans Harry Heinz Henry Jack Jacques James Jean Johann John Jorge José Juan Karl Kevin Klaus Lars Louis Lukas Luis Manuel Marc Mark Martin Matthew Max Michael Miguel Oliver Oscar Pablo Patrick Paul Pedro Peter Philip Pierre Ralph Richard Robert Roger Samuel Simon Stefan Steven Thomas Tom Walter William Wolfgang".split(),
    "Alice Amelia Amy Ana Andrea Angela Anna Anne Barbara Beatrice Carla Carmen Caroline Charlotte Chloe Christine Clara Claire Diana Dorothy Elena Elisabeth Elizabeth Emily Emma Eva Florence Frances Gabriele Grace Hannah Heidi Helen Ingrid Isabel Jane Jennifer Joan Judith Julia Karen Katharina Kate Laura Lena Linda Lisa Louise Lucy Luisa Maria Marie Martha Mary Monika Nicole Olivia Patricia Paula Rachel Rosa Ruth Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Евгений Иван Игорь Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    "Александра Анастасия Анна Валентина Вера Галина Екатерина Елена Ирина Людмила Мария Наталья Надежда Ольга Светлана Татьяна Юлия".split(),
)


GIVEN = "|".join(n for names in GIVEN_NAMES for n in names)
_CAPITAL = r"(?:\p{Lu}|\p{Lt}|\p{Lo})[\p{L}\p{M}'’-]*[\p{L}\p{M}]"
NAME_WORD = rf"(?!(?:{PLACES})\b){_CAPITAL}"
_HEXTET = "[0-9a-fA-F]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]+)*\.[\p{L}\p{M}]{2,}",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEXTET}:){{7}}{_HEXTET}|(?=[0-9a-fA-F:]*\d)(?:{_HEXTET}:){{1,6}}(?::{_HEXTET}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "token": r"(?<![\p{L}\p{N}_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{16,255}|xox[abprs]-[0-9A-Za-z-]{10,255}|sk-[0-9A-Za-z_-]{16,255})(?![\p{L}\p{N}_-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])|(?<![\p{L}\p{N}.,/-])0\d{2,4}[ /-]\d{6,8}(?![\p{L}\p{N}/-])|(?<![\p{L}\p{N}.,/-])0\d{1,4}(?: \d{2,4}){3,4}(?![\p{L}\p{N}/-]| ?\d)",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{32,128}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{13,19})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?<=\b(?:{TITLES})\.? ){NAME_WORD}(?: {NAME_WORD}){{0,2}}|(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{GIVEN})(?: {NAME_WORD}){{1,2}}(?![\p{{L}}\p{{M}}])",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap tests whether a text can hold an entity, or a name, at all.
NAMED = rf"\b(?:{TITLES})\.? (?:\p{{Lu}}|\p{{Lt}}|\p{{Lo}})|(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{GIVEN}) (?:\p{{Lu}}|\p{{Lt}}|\p{{Lo}})"
HINT = rf"@|\d{{2}}|[0-9a-fA-F]{{32}}|:[0-9a-fA-F]|gh[pousr]_|sk-|xox|AKIA|ASIA|{NAMED}"
#: Fixed alphabets of which a letter keeps its row; other letters go by script, case and block of 256 code points.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûü", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
HEX = ("0123456789abcdef", "0123456789ABCDEF")
@lru_cache(1)
def alphabets() -> str:
    """For each block of 256 code points the alphabets of its letters, separated by \\x02, blocks by \\x01: letters of one
    script and category, never one letter alone if the block has others."""
    fixed = {c: row for row in ALPHABETS for c in row}
    blocks = []
    for block in range(0x32400 >> 8):
        rows: dict[tuple, list[str]] = {}
        for i in range(block << 8, (block + 1) << 8):
            c, kind = chr(i), unicodedata.category(chr(i))
            if c in fixed:
                rows.setdefault((fixed[c],), list(fixed[c]))
            elif kind[0] == "L" or kind == "Nd":
                rows.setdefault((unicodedata.name(c, "?").split(" ")[0], kind), []).append(c)
        alone = [k for k, v in rows.items() if len(v) == 1]
        if alone:  # a letter alone joins the others of its case, or all of them
            for k in alone:
                rest = [x for x in rows if x != k and len(x) == 2 and x[1] == k[1]] or [x for x in rows if x != k and len(x) == 2]
                if rest:
                    rows[rest[0]] += rows.pop(k)
        blocks.append("\x02".join("".join(v) for v in rows.values() if len(v) > 1))
    return "\x01".join(blocks)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(*parts: Column) -> Column:
    """A keyed hash below 2 ** 32."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def _characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


#: Rows of characters, or the table of all alphabets as a value that the caller computes once.
Rows = tuple[str, ...] | Column


def with_alphabets(f: Callable[[Column], Column]) -> Column:
    """f of the table of all alphabets; the plan holds the table once, however often f uses it."""
    return _let(F.split(F.lit(alphabets()), "\x01"), f)


def _own(c: Column, rows: Rows) -> Column:
    """The alphabet of a character, null if it has none."""
    table = F.array(*[F.lit(r) for r in rows]) if isinstance(rows, tuple) else F.split(F.get(rows, F.shiftright(F.ascii(c), 8)), "\x02")
    return F.get(F.filter(table, lambda a: F.instr(a, c) > 0), F.lit(0))


def _moved(c: Column, step: Callable[[Column], Column], rows: Rows) -> Column:
    """A character so many places further in its alphabet, or itself if it has none."""
    at = lambda a: F.pmod(F.instr(a, c) - 1 + step(F.length(a)), F.length(a)) + 1
    return F.coalesce(_let(_own(c, rows), lambda a: F.substring(a, at(a).cast("int"), F.lit(1))), c)


def _pass(value: Column, key: Column, rows: Rows) -> Column:
    """Shifts each character within its alphabet by a hash of the letters and digits before it: a bijection for every key.

    What stands between letters has no influence, nor has case: two spellings of a number stay alike."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("before"))

    def step(acc: Column, c: Column) -> Column:
        moved = _moved(c, lambda n: _number(key, acc["before"]), rows)
        return F.struct(F.concat(acc["out"], moved).alias("out"), F.concat(acc["before"], F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))).alias("before"))

    return F.aggregate(_characters(value), start, step, lambda acc: acc["out"])


def permuted(value: Column, key: Column, rows: Rows) -> Column:
    """A keyed permutation of the strings of one shape without fixed points. The rest moves under a key that knows the first
    letter or digit, then that one moves, by 1 place at least, under a key that knows the moved rest: each step can be undone."""

    def done(v: Column) -> Column:
        lead, head = F.regexp_extract(v, r"(?s)^([^\p{L}\p{N}]*)", 1), F.regexp_extract(v, r"(?s)^[^\p{L}\p{N}]*([\p{L}\p{N}])", 1)
        tail = F.substring(v, F.length(lead) + F.length(head) + 1, F.length(v))
        own = F.concat_ws("/", key, F.lower(head))
        moved = F.reverse(_pass(F.reverse(_pass(tail, F.concat(own, F.lit("/l")), rows)), F.concat(own, F.lit("/r")), rows))
        # case and marks between letters have no influence on how far the first one moves
        known = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
        return _let(moved, lambda t: F.concat(lead, F.when(head == "", "").otherwise(_moved(head, lambda n: 1 + F.pmod(_number(key, F.lit("first"), known(t)), n - 1), rows)), t))

    return F.when(value == "", value).otherwise(_let(value, done))


def _ip(value: Column, key: Column) -> Column:
    """The last three octets move under a key of those before, then the first one by 1 or more within its kind (unicast or not)."""

    def done(o: Column) -> Column:
        n = [F.get(o, i).cast("int") for i in range(4)]
        before, out = n[0].cast("string"), []
        for i in (1, 2, 3):
            out.append(F.pmod(n[i] + _number(key, F.lit(str(i)), before), F.lit(256)))
            before = F.concat_ws(".", before, n[i].cast("string"))
        step = lambda size: 1 + F.pmod(_number(key, F.lit("first"), *[x.cast("string") for x in out]), F.lit(size - 1))
        first = F.when(n[0].between(1, 223), F.pmod(n[0] - 1 + step(223), F.lit(223)) + 1).otherwise(F.pmod(F.greatest(n[0] - 223, F.lit(0)) + step(33), F.lit(33)))
        first = F.when(n[0].between(1, 223) | (first == 0), first).otherwise(first + 223)
        return F.concat_ws(".", first.cast("string"), *[x.cast("string") for x in out])

    return _let(F.split(value, r"\."), done)


def luhn_sum(digits: Column) -> Column:
    """The checksum of a number whose last digit counts once."""
    each = F.transform(F.reverse(_characters(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def is_card(value: Column) -> Column:
    return _let(_digits(value), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))


def _card(value: Column, key: Column) -> Column:
    """All but the first digit and the last move; the last one makes the checksum right."""
    body = F.concat(F.substring(value, 1, 1), permuted(F.substring(value, F.lit(2), F.length(value) - 2), F.concat(key, F.lit("/card"), F.substring(value, 1, 1)), ALPHABETS[:1]))
    return _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(_digits(b), F.lit("0"))), F.lit(10)).cast("string")))


def _remainder(account: Column) -> Column:
    """An account number's remainder by 97, its first four characters moved to its end, letters as two digits each."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c >= "A", F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97)))
    return F.aggregate(_characters(turned), F.lit(0), lambda a, c: step(a, c).cast("int"))


def is_account(value: Column) -> Column:
    return _let(F.replace(value, F.lit(" "), F.lit("")), lambda v: F.length(v).between(15, 34) & (_remainder(v) == 1))


def _account(value: Column, key: Column) -> Column:
    """What follows country and checksum moves; the checksum is made right."""
    country = F.substring(value, 1, 2)
    rest = permuted(F.substring(value, F.lit(5), F.length(value)), F.concat(key, F.lit("/iban"), country), ALPHABETS[:1] + ("ABCDEFGHIJKLMNOPQRSTUVWXYZ",))
    check = lambda r: F.lpad((98 - _remainder(F.concat(country, F.lit("00"), F.replace(r, F.lit(" "), F.lit(""))))).cast("string"), 2, "0")
    return _let(rest, lambda r: F.concat(country, check(r), r))


def kind_of(value: Column) -> Column:
    """The type of an entity; an empty string for a number that is no card and no account."""
    out = F.lit("name")
    checked = {"card": is_card, "iban": is_account}
    for kind in ("ssn", "card", "secret", "phone", "iban", "token", "ipv6", "ip", "email"):
        own = F.when(checked[kind](value), kind).otherwise("") if kind in checked else F.lit(kind)
        out = F.when(F.regexp_like(value, F.lit(f"^(?:{PATTERNS[kind]})$")), own).otherwise(out)
    return out


def _given(word: Column, key: Column) -> Column:
    """Another name of the list that has the word, in the word's case; null if none has it."""
    title = F.initcap(word)
    found = F.lit(None).cast("string")
    for i, names in enumerate(GIVEN_NAMES):
        order = F.split(F.lit(" ".join(names)), " ")
        at = F.array_position(order, title)
        step = 1 + F.pmod(_number(key, F.lit(f"given{i}")), F.lit(len(names) - 1))
        found = F.when(at > 0, F.get(order, F.pmod(at - 1 + step, F.lit(len(names))).cast("int"))).otherwise(found)
    return F.when(word == title, found).when((word == F.upper(word)) & (F.length(word) > 1), F.upper(found))


def name_word(word: Column, key: Column, rows: Rows) -> Column:
    """The surrogate of one word of a name."""

    def other(w: Column) -> Column:
        cased = F.regexp_like(w, F.lit(r"^[\p{Lu}\p{Lt}].*[\p{Lu}\p{Ll}]$")) & (F.length(w) > 2)
        last = F.when(cased, F.substring(w, -1, 1)).otherwise("")
        body = F.when(cased, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        once = lambda b: permuted(b, F.concat(key, F.lit("/name"), F.lower(last)), rows)
        # a word that has become a listed name goes on to another one
        return _let(once(body), lambda b: F.concat(F.when(_given(F.concat(b, last), key).isNotNull(), once(b)).otherwise(b), last))

    return _let(word, lambda w: F.coalesce(_given(w, key), other(w)))


def surrogate(value: Column, key: Column, rows: Rows) -> Column:
    """The replacement of one entity; of an address the domain, and of a name each word, is one surrogate wherever it occurs."""
    part = lambda pattern: F.regexp_extract(value, pattern, 1)
    under = lambda *x: F.concat(key, *[F.lit(y) if isinstance(y, str) else y for y in x])
    code = part(r"^(\+\d{1,3})")
    email = F.concat(permuted(part("^(.*)@"), under("/email", F.lower(part("@(.*)$"))), rows), F.lit("@"), permuted(part(r"@(.*)\.[\p{L}\p{M}]+$"), under("/domain"), rows), part(r"(\.[\p{L}\p{M}]+)$"))
    phone = F.concat(code, permuted(F.substring(value, F.length(code) + 1, F.length(value)), under("/phone", code), ALPHABETS[:1]))
    upper = F.regexp_like(value, F.lit("[A-F]"))
    secret = F.when(upper, permuted(value, under("/secret"), HEX[1:])).otherwise(permuted(value, under("/secret"), HEX[:1]))
    prefix = F.regexp_extract(value, r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-)", 1)
    token = F.concat(prefix, permuted(F.substring(value, F.length(prefix) + 1, F.length(value)), under("/token", prefix), ALPHABETS[:5]))
    v6 = F.when(upper, permuted(value, under("/ipv6"), HEX[1:])).otherwise(permuted(value, under("/ipv6"), HEX[:1]))
    name = F.array_join(F.transform(F.split(value, " "), lambda w: name_word(w, key, rows)), " ")

    def by_kind(kind: Column) -> Column:
        out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "secret", secret).when(kind == "ip", _ip(value, under("/ip"))).when(kind == "iban", _account(value, key)).when(kind == "token", token).when(kind == "ipv6", v6)
        return out.when(kind == "card", _card(value, key)).when(kind == "ssn", permuted(value, under("/ssn"), ALPHABETS[:1])).when(kind == "name", name).otherwise(value)

    return _let(kind_of(value), by_kind)


def _pattern(text: Column) -> Column:
    """The entities' pattern, for a text with titled names those names' words too, wherever they occur."""
    said = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda n: F.split(n, " "))))
    said = F.filter(said, lambda w: ~F.regexp_like(w, F.lit(f"^(?:{FAMILIAR})$")))
    words = F.array_distinct(F.concat(said, F.filter(F.transform(said, F.upper), lambda w: F.length(w) > 2)))
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    # words of cased scripts stand alone, which is looked at once for all of them; other scripts put no space between words
    cased = lambda w: F.regexp_like(w, F.lit(r"^[\p{Lu}\p{Lt}]"))
    any_of = lambda ws: F.array_join(F.transform(ws, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|")
    alone, joined = F.filter(longest, cased), F.filter(longest, lambda w: ~cased(w))
    own = F.concat_ws("|", F.lit(ENTITY), F.when(F.size(alone) > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), any_of(alone), F.lit(r")(?![\p{L}\p{M}])"))), F.when(F.size(joined) > 0, any_of(joined)))
    return F.when(F.regexp_like(text, F.lit(NAMED)) & (F.size(words) > 0), own)


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """others (a struct of keep), text, pattern, found: the entities of each text in order."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("others"), F.col(f"`{text}`").alias("text"), _pattern(F.col(f"`{text}`")).alias("pattern"))
    every = F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).when(F.regexp_like("text", F.lit(HINT)), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    return rows.withColumn("found", F.coalesce(every, F.array().cast("array<string>")))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """found: the entities of each text in order."""
    return _found(docs, text, []).select(F.filter("found", lambda e: kind_of(e) != "").alias("found"))


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """others (a struct of the other columns), text with its entities replaced, and pairs (value, surrogate) of all of them."""
    rows = _found(docs, text, [c for c in docs.columns if c != text])
    rows = rows.withColumn("pairs", F.when(F.size("found") > 0, with_alphabets(lambda rows: F.transform("found", lambda e: F.struct(e.alias("value"), surrogate(e, F.lit(key), rows).alias("surrogate"))))))
    parts = F.when(F.col("pattern").isNotNull(), F.split("text", F.col("pattern"), -1)).otherwise(F.split("text", ENTITY, -1))
    whole = F.array_join(F.zip_with(parts, "pairs", lambda p, e: F.concat(p, F.coalesce(e["surrogate"], F.lit("")))), "")
    own = F.filter("pairs", lambda e: e["value"] != e["surrogate"])
    return rows.select("others", F.when(F.size("found") > 0, whole).otherwise(F.col("text")).alias("text"), F.coalesce(own, F.array().cast("array<struct<value:string,surrogate:string>>")).alias("pairs"))


def _unpacked(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    return rows.select(*[F.col("text").alias(text) if c == text else F.col(f"others.`{c}`").alias(c) for c in columns])


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The columns of docs with the entities in column `text` replaced, in one pass without a check of the corpus."""
    return _unpacked(replaced(docs, key, text), docs.columns, text)


def collisions(pairs: DataFrame) -> DataFrame:
    """value, rank for values of pairs (value, surrogate) that another value shares its surrogate with: the smallest has rank
    0 and keeps it. Values meet by surrogate only where there are several, so no group is large."""
    each = pairs.groupBy("surrogate", "value").agg(F.count("*").alias("n"))
    shared = each.groupBy("surrogate").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("found")).where("n > 1")
    return shared.select(F.posexplode("found").alias("rank", "value")).where("rank > 0")


def surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The columns of docs, text with surrogates, and n_entities; no two values of the corpus share a surrogate.

    The texts are written once, each with its pairs; the check reads the pairs alone. Should values collide, the texts that
    hold one of them are pseudonymised word for word again under another key for that value, until none collide."""
    columns = docs.columns
    found = stored(replaced(docs.withColumn("original", F.col(f"`{text}`")), key, text), "surrogates")
    for version in range(1, 20):
        bad = stored(collisions(found.select(F.inline("pairs"))), "collisions")
        if bad.isEmpty():
            dropped(bad)
            names = [F.col("text").alias(text) if c == text else F.col(f"others.`{c}`").alias(c) for c in columns]
            return found.select(*names, F.size("pairs").cast("long").alias("n_entities"))
        found = stored(_again(found, bad, f"{key}/{version}", text), "surrogates")
    raise ValueError("values of the corpus still share a surrogate under 20 keys")


def _again(found: DataFrame, bad: DataFrame, key: str, text: str) -> DataFrame:
    """found with other surrogates for the values of bad. Rows that hold none are left as they are."""
    named = found.withColumn("row", F.xxhash64("others", "text"))
    hit = named.select("row", F.inline("pairs")).join(bad.select("value").distinct(), "value").select("row", "value", with_alphabets(lambda rows: surrogate(F.col("value"), F.lit(key), rows)).alias("new")).distinct()
    new = hit.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("value", "new"))).alias("new"))  # the values of one text
    rows = named.join(new, "row", "left")
    pairs = F.transform("pairs", lambda p: F.struct(p["value"].alias("value"), F.coalesce(F.try_element_at("new", p["value"]), p["surrogate"]).alias("surrogate")))
    own = F.col(f"others.original")
    pattern = F.coalesce(_pattern(own), F.lit(ENTITY))
    told = F.map_from_entries(F.array_distinct(pairs))
    whole = F.array_join(F.zip_with(F.split(own, pattern, -1), F.regexp_extract_all(own, pattern, F.lit(0)), lambda p, e: F.concat(p, F.coalesce(F.try_element_at(told, e), e, F.lit("")))), "")
    return rows.select("others", F.when(F.col("new").isNull(), F.col("text")).otherwise(whole).alias("text"), F.when(F.col("new").isNull(), F.col("pairs")).otherwise(pairs).alias("pairs"))
